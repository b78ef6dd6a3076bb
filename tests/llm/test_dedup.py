import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import exact_dedup, simhash
from parley.llm.components import components
from tests.llm.support import DOCS, TEXTS, empty_docs, odd_docs, rows_of, shared


def exact_by_hand(docs):
    groups = {}
    flat = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in docs]
    for k, f in enumerate(flat):
        groups.setdefault(f, []).append(k)
    best = {f: min(g, key=lambda k: (-len(docs[k][1] or ""), docs[k][0] is None, docs[k][0] or 0)) for f, g in groups.items()}
    return [(docs[k][0], docs[best[f]][0], len(groups[f]), docs[k][0] == docs[best[f]][0] and len(docs[k][1] or "") == len(docs[best[f]][1] or ""), hashlib.sha256(f.encode()).hexdigest()) for k, f in enumerate(flat)]


def in_order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda flat: F.substring(F.sha2(flat, 256), 1, 1), lambda flat: F.lit("same")])
def test_exact_of_odd_rows(spark, digest):
    got = [tuple(r)[:5] for r in exact_dedup.decide(odd_docs(spark), digest).collect()]
    assert in_order(got) == in_order(exact_by_hand(TEXTS))


def test_exact_hot_group(spark):
    rows = [(i, "a b" + " " * (i % 3)) for i in range(4000)] + [(i, f"t {i % 1500}") for i in range(4000, 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert in_order(tuple(r)[:5] for r in exact_dedup.decide(docs).collect()) == in_order(exact_by_hand(rows))
    assert exact_dedup.drop_duplicates(docs).count() == 1501


def test_exact_drop_keeps_columns_and_one_of_repeated_rows(spark):
    docs = odd_docs(spark)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in TEXTS})
    assert exact_dedup.decide(empty_docs(spark)).count() == 0 and exact_dedup.drop_duplicates(empty_docs(spark)).count() == 0


def test_exact_like_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.execute(exact_dedup.oracle()).fetchall()
    got = [tuple(r) for r in exact_dedup.decide(spark.read.parquet(f"{small}/documents.parquet")).collect()]
    assert sorted(got) == sorted(want)


def fingerprint_by_hand(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    k = min(n, len(words))
    hashes = [xxhash.xxh64(" ".join(words[i : i + k]).encode(), seed=42).intdigest() for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_by_hand(docs):
    fps = np.array([fingerprint_by_hand(t) for _, t in docs], np.uint64)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if int(fps[i] ^ fps[j]).bit_count() <= 4]
    root = shared(links, len(fps))
    least = {}
    for k, r in enumerate(root):
        i = docs[k][0]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(docs[k][0], f"{int(fps[k]):016x}", least.get(r)) for k, r in enumerate(root)]


def test_near_of_odd_rows(spark):
    short = [(i, t if t is None or len(t) < 9000 else t[:3000]) for i, t in TEXTS]
    got = [tuple(r) for r in simhash.near_duplicates(odd_docs(spark, short)).collect()]
    assert in_order(got) == in_order(near_by_hand(short))
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_near_of_documents(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(small, "documents")]
    got = [tuple(r) for r in simhash.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")).collect()]
    assert in_order(got) == in_order(near_by_hand(docs))


def test_golay_code_is_perfect():
    table = simhash.golay_index()
    assert np.bincount(table, minlength=4096).tolist() == [2048] * 4096


def test_linked_fingerprints_share_a_key():
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(3000)]
    near = [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for f in fps]
    a, b = (simhash.fuzzy_keys(np.array(x, np.uint64)) for x in (fps, near))
    assert all({*x[x >= 0].tolist()} & {*y[y >= 0].tolist()} for x, y in zip(a, b))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_what_links(spark, monkeypatch, block):
    """Crowded keys, dealt out by pairs of small blocks, lose no link."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    fps = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps |= {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(60)}
    fps = sorted(fps)
    want = shared([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], len(fps))
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    place = {signed(f): k for k, f in enumerate(fps)}
    found = [(place[r.u], place[r.v]) for r in simhash.links(frame).collect()]
    assert all((fps[i] ^ fps[j]).bit_count() <= 4 for i, j in found)
    assert shared(found, len(fps)) == want


def test_a_distance_beyond_the_keys_is_refused(spark):
    frame = spark.createDataFrame([(0,), (31,)], "fp long")
    with pytest.raises(ValueError):
        simhash.links(frame, 5)
    assert simhash.links(frame, 3).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    links += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(260)]
    rng.shuffle(links)
    frame = spark.createDataFrame([*links, (None, 5), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(frame, "u", "v").collect()}
    root = shared(links, 3400)
    assert got == {i: root[i] for pair in links if pair[0] != pair[1] for i in pair}
    assert components(frame.limit(0), "u", "v").count() == 0
    assert DOCS
