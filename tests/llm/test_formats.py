"""Chat formatting, media columns and licence scans against plain Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from loomweb.llm import chat_format, license_scan, media
from loomweb.llm.shared import new_folder, qualified


def test_chat_round_trip_and_loss(spark):
    rng = random.Random(1)
    pieces = ["<s>", "</s>", "[INST]", "\\l", "\\", "\\b", "a\nb", "", "ü😀", "[", "<"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "sys\ntem"]), rng.choice([None, *("".join(rng.choices(pieces, k=3)) for _ in range(3))]), "x"))
    rows += [(None, 0, None, "hi", "x"), (None, 1, "assistant", "yo", "x"), (99, 0, "assistant", "twice", "x"), (99, 0, "assistant", "twice", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chat(frame).withColumn("turns", chat_format.parse_chat(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")))
    got = out.collect()
    truth = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or "")):
        truth.setdefault(conv, []).append((role or "", text or ""))
    for conv, turns in truth.items():
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.example)
        assert [r.example for r in mine] == [i for i, (role, _) in enumerate(turns, 1) if role == "assistant" or i == len(turns)]
        for r in mine:
            assert [tuple(t) for t in r.turns] == turns[: r.example]
            assert r.loss == (turns[r.example - 1][1] if turns[r.example - 1][0] == "assistant" else None)
    assert chat_format.format_chat(frame.limit(0)).count() == 0


def test_media_columns_are_lossless(spark):
    texts = ["", None, "a", "é" * 300, "x" * 576, "y" * 577, "z" * 200_000, "a"]
    frame = spark.createDataFrame([(i if i < 7 else None, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    folder = qualified(spark, new_folder(spark, "media-test"))
    manifest = media.store(frame.repartition(3), folder)
    read = media.read_back(manifest, folder, lambda png: (hashlib.sha256(media.from_png(png)).hexdigest(),), "payload string").collect()
    assert len(read) == len(texts)
    for r in read:
        raw = (texts[r.doc_id if r.doc_id is not None else 7] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert r.payload == r.digest == hashlib.sha256(payload).hexdigest() and r.n_bytes == len(raw)
    heads = media.metadata(media.spread(manifest), folder).collect()
    assert {(h.width, h.bits) for h in heads} == {(576, 8)} and max(h.height for h in heads) == -(-200_000 // 576)
    assert media.index_of(manifest).count() == len({hashlib.sha256(media.padded(t)[0]).digest() for t in texts})
    assert zlib.crc32(media.padded("a")[0][-32:]) == zlib.crc32(b"\xff" * 32)
    assert media.store(frame.limit(0), qualified(spark, new_folder(spark, "media-none"))).count() == 0


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def test_licences_equal_brute_force(spark):
    """Lines, paragraphs and texts; windows, which are reported besides, have a test of their own."""
    rng = random.Random(2)
    grams = {n: set(license_scan.template_bigrams(t)) for n, t in license_scan.TEMPLATES.items()}
    texts = [None, "", "MIT", "plain text", "Released under the MIT License."]
    for template in license_scan.TEMPLATES.values():
        for share in (0.0, 0.05, 0.1, 0.2):
            words = [w if rng.random() >= share else "edit" for w in template.split()]
            texts += [" ".join(words).upper(), f"head line\n{' '.join(words)}\n\ntail of it", f"{'filler ' * 30}\n\n{' '.join(words[: len(words) // 2])}\n{' '.join(words[len(words) // 2 :])}\n\nend"]
    frame = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {r.doc_id: {(m.kind, m.position, m.license, round(m.dice, 9)) for m in r.matches if m.kind != "window"} for r in license_scan.scan_licenses(frame).collect()}
    import re

    for i, t in enumerate(texts):
        want = set()
        for kind, parts in (("line", (t or "").split("\n")), ("paragraph", re.split("\n[ \t\r]*\n", t or "")), ("text", [t or ""])):
            for k, part in enumerate(parts):
                own = set(license_scan.template_bigrams(part))
                best = max(((dice(own, g), n) for n, g in grams.items()), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
                if best[0] >= license_scan.THRESHOLD:
                    want.add((kind, k, best[1], round(best[0], 9)))
        assert got[i] == want, t
