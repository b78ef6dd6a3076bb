import random
import re

import corpus_pipeline
from parley.llm import near_text, pii
from tests.llm.support import empty_docs, odd_docs, rows_of, shared
from tests.llm.test_dedup import exact_by_hand
from tests.llm.test_text_operators import base_by_hand, frame_by_hand, measured_by_hand
from tests.llm.test_token_files import check_packing


def kept_by_rules(text):
    """The quality rules, plainly, but for texts that take too long: their longest repeat and its shares by sorting."""
    return measured_by_hand(text)[-1] if len(text or "") < 6000 else long_one_kept(text)


def long_one_kept(text):
    if base_by_hand(text)[-1]:
        return False
    t = " ".join(re.findall(r"[^\x20\x09-\x0D]+", frame_by_hand(text)))
    n = len(t)
    least = 1
    while 2**least <= n:
        least += 1
    inside = [False] * n
    windows = {}
    for i in range(n - least + 1):
        windows.setdefault(t[i : i + least], []).append(i)
    for at in windows.values():
        for i in at if len(at) > 1 else ():
            inside[i : i + least] = [True] * least
    long = {}
    return 5 * sum(inside) <= n and not any(long.setdefault(t[i : i + 251], i) != i for i in range(n - 250))


def test_whole_pipeline_by_hand(spark, small):
    """Every stage by a plain version of its rules, over all texts, long ones too."""
    docs = [(r["doc_id"], r["text"]) for r in rows_of(small, "documents")]
    docs = [d for d in docs if kept_by_rules(d[1])]
    docs = [d for d, e in zip(docs, exact_by_hand(docs)) if e[3]]
    docs = [docs[k] for k in sorted(alike_by_hand(docs))]
    docs = [(i, pii.masked(t, pii.find(t))) for i, t in docs]
    got = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in got} == {i for i, _ in docs}
    bins, least = check_packing(got, docs, 0, 2048)
    assert bins <= least + 1


def test_stages_keep_columns_and_take_odd_rows(spark, small):
    for docs in (odd_docs(spark), empty_docs(spark)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, small)
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
            out.count()


def test_near_copies_go_and_clean_documents_stay(spark, small):
    rng = random.Random(2)
    base = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)) for _ in range(30)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, re.sub(r"\S+$", "changed", t)) for k, t in enumerate(base[:10])]
    left = {r.doc_id for r in near_text.keep_one(odd_docs(spark, rows)).collect()}
    assert left == set(range(30))


def shingle_sets(docs):
    out = []
    for _, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        k = min(5, len(words))
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    return out


def alike_by_hand(docs):
    """Places of the documents that stay where five-word shingles of Jaccard similarity 0.8 link."""
    sets = shingle_sets(docs)
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    best = {}
    for k, r in enumerate(shared(links, len(docs))):
        best[r] = min(best.get(r, k), k, key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    return set(best.values())


def test_near_stage_drops_what_is_four_fifths_alike(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in rows_of(small, "documents")]
    docs = [d for d, e in zip(docs, exact_by_hand(docs)) if e[3]]
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd_docs(spark, docs), small).collect()}
    want = {docs[k][0] for k in alike_by_hand(docs)}
    assert left == want and 1 in left and 177 not in left  # 0.83 alike, nine bits apart


def test_near_stage_at_the_limit_and_over_blocks(spark, small, monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for m in range(6):
            words = list(base)
            for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5, 6])):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((100 * k + m, " ".join(words)))
    for block in (near_text.BLOCK, 2):
        monkeypatch.setattr(near_text, "BLOCK", block)
        left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, odd_docs(spark, rows), small).collect()}
        assert left == {rows[k][0] for k in alike_by_hand(rows)} and len(left) < len(rows)


def test_near_stage_leaves_one_row_of_repeated_ids(spark, small):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(1, text), (2, text + " end"), (2, "quite another text"), (3, "one more text"), (3, "one more text"), (None, "one more text"), (4, ""), (5, None)]
    left = corpus_pipeline.near_duplicates(spark, odd_docs(spark, rows), small).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, text), (2, "quite another text"), (3, "one more text"), (4, "")]


def test_near_stage_loses_no_text_of_repeated_ids(spark, small):
    """Repeated and null ids among near copies, the same id on both sides, exact repeats: one row of every class stays."""
    rng = random.Random(12)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(8)]
    rows = [(1, " ".join(base[0])), (9, " ".join([*base[0], "end"])), (9, " ".join(base[1])), (20, " ".join([*base[1], "end"]))]
    for _ in range(120):
        words = list(rng.choice(base))
        words[rng.randrange(60)] = rng.choice(["x", "y", words[0]])
        rows.append((rng.choice([None, 3, 4, 5, 30, 31]), " ".join(words)))
    left = corpus_pipeline.near_duplicates(spark, odd_docs(spark, rows), small).collect()
    sets = shingle_sets(rows)
    root = shared([(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)], len(rows))
    class_of = dict(zip((r for r in rows), root))
    assert sorted(class_of[r.doc_id, r.text] for r in left) == sorted(set(root))
    least = {c: min((i is None, i or 0) for (i, _), k in zip(rows, root) if k == c) for c in set(root)}
    assert all((r.doc_id is None, r.doc_id or 0) == least[class_of[r.doc_id, r.text]] for r in left)
