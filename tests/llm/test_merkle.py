import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from evenkeel.llm import merkle, queries


def H(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Root and, for each leaf, its steps."""
    steps, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 3 * 3:a // 3 * 3 + 3]
            steps[i].append(("".join(run[:a % 3]), "".join(run[a % 3 + 1:])))
            at[i] = a // 3
        nodes = [H(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0] if nodes else None, steps


def manifest(rows):
    """Over (doc_id, text, lang, source, n_chars): rows of the query."""
    groups = defaultdict(list)
    for r in rows:
        i, text, lang, source, n = r
        groups[source].append((i is not None, i or 0, H(*map(enc, (i, source, lang, n, text))), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    roots, found = [], {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        root, steps = tree([x[2] for x in groups[s]])
        roots.append(root)
        found[s] = steps
    root, upper = tree(roots)
    out = []
    for s, sub, up in zip(names, roots, upper):
        for (_, _, leaf, (i, text, lang, source, n)), steps in zip(groups[s], found[s]):
            h = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                h = H(*map(enc, (i, source, lang, n, text if text is None else text.replace("\n", ""))))
            for left, right in steps + up:
                h = H(left, h, right)
            out.append((i, leaf, sub, root, H("".join(a + b for a, b in steps + up)), h, h == root))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def rows_of(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a\nb", "plain", "", None, "é\n\n", "x" * 300]), rng.choice(["en", None]), rng.choice(["hot"] * 6 + ["a", "é", "", None, "+", "b"]), rng.choice([None, i])) for i in range(n)]
    rng.shuffle(rows)
    return rows + [rows[0], rows[0], (None, "n\n", None, "hot", 1), (None, None, None, None, None), (7, "other\n", "en", "hot", 2), (99991, "alone\nx", "en", "single", 1)]


def run(spark, rows, tmp_path, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS leaf", "'y' AS h", "1 AS at", "2 AS n", "3 AS _g")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return queries.op13_merkle_manifest(spark, str(tmp_path)).select(COLUMNS)


@pytest.mark.parametrize("n", [0, 1, 40, 900])
def test_equals_brute_force_and_sql(spark, tmp_path, n):
    rows = rows_of(n) if n > 1 else [(5, "q\nr", None, None, 3)][:n]
    got = sorted(map(str, map(tuple, run(spark, rows, tmp_path, extra=n == 40).collect())))
    assert got == sorted(map(str, manifest(rows)))
    if n:
        c = duckdb.connect()
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        rel = c.execute(queries.oracle_sql()["op13_merkle_manifest"])
        assert [d[0] for d in rel.description] == COLUMNS
        assert sorted(map(str, rel.fetchall())) == got
    if n == 900:
        assert 0 < sum(g.endswith("False)") for g in got) < len(got)


def test_pieces_over_several_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "PIECE", 9)
    rows = rows_of(1200, 5)  # the hot source needs four rounds of two levels
    got = sorted(map(str, map(tuple, run(spark, rows, tmp_path).collect())))
    assert got == sorted(map(str, manifest(rows)))


def test_full_runs_and_proofs(spark):
    df = spark.range(27).selectExpr("id AS doc_id", "'s' AS source", "cast(id AS string) AS text")
    got = merkle.merkle_manifest(df, ["doc_id", "text"], carry={"even": df.doc_id % 2 == 0}).collect()
    assert {len(r.proof) for r in got} == {3} and all(len(s.left) + len(s.right) == 128 for r in got for s in r.proof)
    assert all(r.even == (r.doc_id % 2 == 0) and r.subroot == r.root for r in got)
    assert merkle.merkle_manifest(df.limit(0), ["doc_id"]).count() == 0
