"""Small tables with every odd case, and plain versions of shared steps."""

import pyarrow.parquet as pq

LONG = "word " * 30_000 + "end"
TEXTS = [
    (1, "The cat sat on the mat, and the dog ran off with +1 (366) 555-9807 today."),
    (2, "The  cat sat on\nthe mat, and the dog ran off with +1 (366) 555-9807 today."),
    (3, None), (4, ""), (5, " \t\n\x0b"), (6, LONG), (7, LONG), (None, "no id here"), (None, None), (8, "Über die Straße, naïve café. ΑΣ ΣΑΣ İstanbul 日本語🙂"),
    (9, "a"), (9, "a"), (9, "b"), (10, "Don't mail x.y+z@mail.example.com or 10.0.0.1 with 4111 1111 1111 1111"), (11, "<|endoftext|> it's \x1c odd"), (12, "ab" * 4000),
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, flat string, fp long, key int, root long, best string, `group` int, digest string"


def odd_docs(spark, rows=None):
    rows = TEXTS if rows is None else rows
    full = [(i, t, None if k % 3 else "en", None if k % 4 == 0 else "src0", None if t is None else len(t), 7, "x", 1, 2, None, "b", 3, "d") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(small, name):
    return pq.read_table(f"{small}/{name}.parquet").to_pylist()


def shared(links, n):
    """Smallest member of each class of 0..n-1 under links."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
