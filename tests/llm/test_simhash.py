import random
import re
from collections import Counter

import xxhash

from loomweb.llm import components, simhash


def plain_fingerprint(text):
    """The contract, bit by bit."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Components of all pairs at 3 or fewer bits."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    base = [[rng.choice(words) for _ in range(rng.randrange(1, 400))] for _ in range(60)]
    texts = [None, "", "  \n", "ÀB c", "Àb C", "one", "One two"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randrange(0, 4)):
            c = list(b)
            for _ in range(rng.randrange(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append("\t".join(c).upper())
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp int, component_id string").repartition(5)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: g[0] for i, g in got.items()} == fps
    assert {i: g[1] for i, g in got.items()} == classes(fps)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(fps).values()))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0 and simhash.keep_one(frame.limit(0)).count() == 0


def test_large_groups_in_blocks(spark):
    """Chains and stars of fingerprints whose signatures are cut into several blocks."""
    rng = random.Random(9)
    fps = {rng.getrandbits(63) for _ in range(200)}
    centre = rng.getrandbits(63)
    for _ in range(300):
        near = centre
        for b in rng.sample(range(63), 2):
            near ^= 1 << b
        fps.add(near)
    chain = rng.getrandbits(63)
    for b in range(0, 60, 3):
        chain ^= 0b111 << b
        fps.add(chain)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = classes({f: f for f in fps})
    for block in (16, 4096):
        links = simhash.link(frame, block)
        roots = {r.node: r.root for r in components.connected(links).collect()}
        assert {f: roots.get(f, f) for f in fps} == want
        assert links.count() < 8 * 66 * len(fps)


def test_rows_that_share_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "x y z q r s"), (None, "a b c d e"), (None, "m n o p q"), (2, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter({(1, "a b c d e"): 1, (1, "x y z q r s"): 1, (None, "m n o p q"): 1, (2, None): 1})


def test_long_texts_are_counted_in_slices(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(500)) for _ in range(n)) for n in (900, 3, 0, 250, 1)]
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 100)
    assert [int(f) & (1 << 64) - 1 for f in simhash.fingerprints_of(texts)] == [plain_fingerprint(t) for t in texts]


def test_the_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    want = {(i, f"{fps[i]:016x}", root) for i, root in classes(fps).items()}
    assert {tuple(r) for r in simhash.op6_simhash(spark, "/root/testdata/sf0.001").select("doc_id", "fingerprint", "component_id").collect()} == want


def test_exploded_signatures_are_not_broadcast(spark):
    """Adaptive execution takes the 66 rows of each fingerprint for one, small enough to be sent to the driver."""
    rng = random.Random(2)
    fps = [rng.getrandbits(63) for _ in range(500)]
    links = simhash.link(spark.createDataFrame([(f ^ flip,) for f in fps for flip in (0, 1)], "fp long"))
    assert len(links.collect()) == 500
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan.split("Initial Plan")[0]
