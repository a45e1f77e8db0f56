"""Queries on small tables whose results differ if a part of the rows or values is left out."""

from collections import Counter

import duckdb

from engram import registry


def both(spark, folder, name, **tables):
    """Sorted rows of a query, by Spark and by its SQL, over ``tables`` (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    made = registry.queries()[name](spark, str(folder))
    cur = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in made.columns]
    return sorted(map(tuple, made.collect())), sorted(tuple(r[i] for i in at) for r in cur.fetchall())


def test_junk_is_judged_on_whole_values(spark, tmp_path):
    word, url = "again " * 8, "https://example.com/a/path/of/forty/chars"
    texts = [word + "but then a long and plain sentence of many other words follows it here", url + " is a page on the design of the store", "one plain sentence of words before the rest " + "z" * 200, url + "/and/more"]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    spark_rows, sql_rows = both(spark, tmp_path, "junk_filter", conversations=(rows, "conv_id bigint, turn int, role string, text string"))
    expected = []
    for i, t in enumerate(texts):
        words = t.lower().split()
        heavy = max(Counter(t.strip()).values()) / len(t.strip()) > 0.6 or (len(words) >= 3 and max(Counter(words).values()) / len(words) > 0.6)
        expected.append((1, i, "bare URL without context" if len(words) == 1 else "repetitive content" if heavy else None))
    assert [r[2] for r in expected] == [None, None, "repetitive content", "bare URL without context"]
    assert spark_rows == expected and sql_rows == expected


def test_import_graph_has_every_line(spark, tmp_path):
    lines = [(s, p) for s in (1, 2, 7, 30) for p in (3, 8, 39, 48, 79) if (s + p) % 3]
    edges = {(f"s{s}", f"p{p % 40}") for s, p in lines} | {(f"p{p % 40}", f"t{s % 4}") for s, p in lines}
    dst = Counter(a for a, _ in edges)
    into = lambda n: sorted(a for a, b in edges if b == n)
    back = sorted([(a, 1, f"t1>{a}") for a in into("t1")] + [(b, 2, f"t1>{a}>{b}") for a in into("t1") for b in into(a)])
    first = {b for a, b in edges if a == "s2"}
    ahead = sorted([(n, 1) for n in first] + [(n, 2) for n in {b for a, b in edges if a in first}])
    for name, expected in (("dependency_map", sorted(dst.items())), ("impact_paths", back), ("blast_radius", ahead)):
        spark_rows, sql_rows = both(spark, tmp_path / name, name, lineitem=(lines, "l_suppkey bigint, l_partkey bigint"))
        assert spark_rows == expected and sql_rows == expected


def test_all_files_meet_their_commits(spark, tmp_path):
    lines = [(o, n, p) for o in (1, 2, 3, 4) for n, p in ((1, 7), (2, 49), (3, 50), (4, 1999))]
    orders = [(o, "FOP"[o % 3]) for o in (1, 2, 3)]
    status = {o: s for o, s in orders if o % 3}
    expected = sorted((o, n, status.get(o, "")) for o, n, _ in lines)
    spark_rows, sql_rows = both(spark, tmp_path, "file_history_commits", lineitem=(lines, "l_orderkey bigint, l_linenumber bigint, l_partkey bigint"), orders=(orders, "o_orderkey bigint, o_orderstatus string"))
    assert spark_rows == expected and sql_rows == expected


def test_paths_start_at_all_documents(spark, tmp_path):
    ids = [0, 1, 2, 3, 6, 13, 27, 54, 109, 199, 218, 437, 875, 1751, 3503]
    expected = []
    for n in ids[2:]:
        via = [n]
        while via[-1] > 1 and via[-1] in ids and len(via) <= 10:
            via.append(via[-1] // 2)
        if via[-1] == 1:
            expected.append((n, 1, len(via) - 1, ">".join(map(str, via))))
    assert {875, 1751} <= {r[0] for r in expected} and 3503 not in {r[0] for r in expected}
    spark_rows, sql_rows = both(spark, tmp_path, "shortest_path", documents=([(i,) for i in ids], "doc_id bigint"))
    assert spark_rows == sorted(expected) and sql_rows == sorted(expected)
