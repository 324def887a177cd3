"""Web-document search and analytics as Spark DataFrame operators."""
