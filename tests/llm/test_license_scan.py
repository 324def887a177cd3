"""Licences in lines, paragraphs, whole files and inside longer units; defined rows."""

from loomweb.llm import license_scan as ls


def found(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, matches string")
    return {r.doc_id: r.matches for r in ls.scan_licenses(frame).collect()}


def test_files_comments_and_long_lines(spark):
    mit, bsd = ls.TEMPLATES["MIT"], ls.TEMPLATES["BSD-3-Clause"].replace(" 1.", "\n\n1.").replace(" 2.", "\n\n2.").replace(" 3.", "\n\n3.")
    comment = "\n".join(" * " + mit[i : i + 60] for i in range(0, 240, 60)) + "\n" + "\n".join(" * " + mit[i : i + 60] for i in range(240, len(mit), 60))
    texts = [
        f"MIT License\n\nCopyright (c) 2020 A. Person\n\n{mit}\n\n{ls.TEMPLATES['MIT-warranty']}",
        f"Copyright 1999\n\n{bsd}\n\n{ls.TEMPLATES['BSD-disclaimer']}",
        f"/*\n{comment}\n */\nint main() {{ return 0; }}\n" + "x = y + 1\n" * 400,
        "Readers may like to know that this file is Released under the MIT License. and that it has more to say " + "word " * 300,
        "Nothing here about software at all. " * 50,
    ]
    got = {i: {m.license for m in ms} for i, ms in found(spark, texts).items()}
    assert {"MIT", "MIT-warranty"} <= got[0] and {"BSD-3-Clause", "BSD-disclaimer"} <= got[1]
    assert "MIT" in got[2] and "MIT-line" in got[3] and got[4] == set()
    assert [m.kind for m in found(spark, [texts[3]])[0]] == ["window"]


def test_windows_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    texts = []
    for _ in range(30):
        words = [rng.choice("alpha beta gamma delta the of".split()) for _ in range(rng.randrange(0, 80))]
        for name in rng.sample(sorted(ls.TEMPLATES), 2):
            copy = [w for w in ls.template_words(ls.TEMPLATES[name]) if rng.random() > rng.choice([0, 0.04, 0.1])]
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
        texts.append(" ".join(words))
    got = found(spark, texts)
    for i, text in enumerate(texts):
        words, want = ls.template_words(text), set()
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        for name, template in ls.TEMPLATES.items():
            grams, length = set(ls.template_bigrams(template)), len(ls.template_words(template))
            rated = [(2 * len(grams & (own := set(pairs[at : at + length - 1]))) / (len(grams) + len(own)), -at) for at, p in enumerate(pairs) if p in grams]
            if rated and max(rated)[0] >= ls.THRESHOLD:
                want.add((name, -max(rated)[1]))
        assert {(m.license, m.position) for m in got[i] if m.kind == "window"} == want


def test_defined_rows(spark):
    line = ls.TEMPLATES["GPL-3.0-line"]
    got = found(spark, [None, "", "  \n\n ", line, line, f"{line}\n" * 3, "license " * 100_000])
    assert [len(got[i]) for i in range(3)] == [0, 0, 0] and got[3] == got[4] and {m.license for m in got[3]} == {"GPL-3.0-line"}
    assert sum(m.kind == "line" for m in got[5]) == 3 and got[6] == []
    assert ls.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
