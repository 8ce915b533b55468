import hashlib
import math
from collections import Counter

import pytest

from moraine.llm import mixing, quality

from .conftest import PROSE


@pytest.mark.parametrize("name,query,sql", [("quality", quality.op3_quality_rules, quality.ORACLE["op3_quality_rules"]), ("mixing", mixing.op4_mixing, mixing.ORACLE["op4_mixing"])])
def test_as_sql_has_it(spark, small, duck, name, query, sql):
    got, want = query(spark, small).toPandas(), duck.sql(sql).df()
    key = [c for c in ("doc_id", "copy") if c in got.columns]
    order = sorted(got.columns)
    assert got[order].sort_values(key).reset_index(drop=True).equals(want[order].sort_values(key).reset_index(drop=True))


def kept(spark, *lines):
    row = quality.clean(spark.createDataFrame([(1, "\n".join(lines), 0)], "doc_id long, text string, n_chars long"), min_share=0.0).first()
    return [] if row is None else row.text.split("\n")


def test_rules_for_lines(spark):
    good = [PROSE, "A title", "Total: 1,200.50 (up 3 %).", "", "Write to a@b.org or +1 (555) 010-0000 today."]
    bad = [
        "Home | News | About | Contact", "BUY!! NOW!! CHEAP!! STUFF!!", "re*** ab### to%%% the&&& of***", "word " * 40, "Licensed under the Apache License, Version 2.0.",
        "one two three four five six seven eight nine ten eleven twelve thirteen", "Login", "© 2024 Somebody. All rights reserved.",
    ]
    assert kept(spark, *good, *bad) == good
    assert all(kept(spark, PROSE, b) == [PROSE] for b in bad)


def test_scripts_without_blanks(spark):
    """Points in names and a few marks are prose in a line of many letters; menus and runs of marks stay what they are."""
    good = ["米开朗基罗·博那罗蒂·西莫尼是意大利文艺复兴时期的雕塑家和画家。", "この商品は100%天然素材でできていて、価格は一つ$20から大きいものの$30までとなっています。", "ประเทศไทยมีประชากรมากกว่า 60 ล้านคน + 5% ในปี."]
    bad = ["首页|新闻|关于|联系", "买!!快!!来!!买!!"]
    assert kept(spark, *good, *bad) == good


def test_scripts_as_sql_has_them(spark):
    import duckdb

    lines = ["米开朗基罗·博那罗蒂·西莫尼是雕塑家。", "首页|新闻|关于|联系", "买!!快!!来!!买!!", PROSE]
    rows = [(i, "\n".join(lines[i:] + lines[:1]), "zh", "s", 1) for i in range(4)] + [(9, None, None, None, None), (10, "", "zh", "s", 0)]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = c.sql(quality.ORACLE["op3_quality_rules"]).fetchall()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(tuple(r) for r in quality.clean(docs).select("doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed").collect()) == sorted(want)


def test_documents_that_lose_too_much_go(spark):
    junk = "BUY!! NOW!! CHEAP!! STUFF!! " * 10
    rows = spark.createDataFrame([(1, f"{PROSE}\n{junk}", 0), (2, f"{PROSE}\n{PROSE}\n{junk[:90]}", 0), (3, junk, 0)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in quality.clean(rows).collect()}
    assert set(out) == {2} and out[2].n_removed == 1 and out[2].n_lines == 3 and out[2].n_chars == len(out[2].text)


def test_odd_documents(odd, none):
    out = quality.stage(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1, None: 1, 6: 1, 7: 1, 9: 2, 10: 1}
    assert all(r.n_lines == 4 and r.n_chars == len(r.text) for r in rows)
    assert quality.clean(none).count() == 0 and set(quality.clean(odd).columns) == set(odd.columns) | {"n_removed"}


def fill(sizes, weights, epochs, budget):
    """Water-filling by rounds: clamp what is over its cap, share out the rest in proportion, again until all fit."""
    open_, left, out = dict(weights), budget, {}
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w >= sizes[s] * epochs]
        if not over:
            return out | {s: level * w for s, w in open_.items()}
        for s in over:
            out[s] = sizes[s] * epochs
            left -= out[s]
            del open_[s]
    return out


@pytest.mark.parametrize("share", [0.5, 1.0, 2.0, 3.9, 10.0])
def test_rates_are_those_of_the_rounds(spark, share):
    sizes = {"a": 1000, "b": 50, "c": 50, "d": 300, "e": 7}
    weights = {"a": 1.0, "b": 5.0, "c": 5.0, "d": 0.5, "e": 3.0}
    rows = spark.createDataFrame([(i, "x", s, n) for i, (s, n) in enumerate(sizes.items())], "doc_id long, text string, source string, n_chars long")
    got = {r.source: r.rate * sizes[r.source] for r in mixing.rates(rows, weights, 1.0, 4.0, share).collect()}
    want = fill(sizes, weights, 4.0, share * sum(sizes.values()))
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9) for s in sizes)


def test_repetition_is_seeded(spark):
    rows = spark.createDataFrame([(i, "x" * 10, "a" if i % 3 else "b", 10) for i in range(3000)], "doc_id long, text string, source string, n_chars long")
    one = mixing.mix(rows, {"a": 1.0, "b": 1.0}, seed=7).collect()
    assert sorted(one) == sorted(mixing.mix(rows.repartition(7), {"a": 1.0, "b": 1.0}, seed=7).collect())
    copies = Counter((r.source, r.doc_id) for r in one)
    assert {n for (s, _), n in copies.items() if s == "b"} == {1, 2} and abs(sum(n for (s, _), n in copies.items() if s == "b") - 1500) < 90
    draw = lambda i: int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:8], 16) / 2**32
    assert all((copies["a", i] > 0) == (draw(i) < 0.75) for i in range(3000) if i % 3)


def test_odd_sources(odd, none):
    out = mixing.mix(odd, {"c": 0.0}, max_epochs=2.0)
    assert sorted(out.columns) == sorted(odd.columns)
    rows = out.collect()
    assert not [r for r in rows if r.source == "c"] and max(Counter((r.doc_id, r.source, r.text) for r in rows).values()) <= 4
    assert {r.source for r in rows} == {"a", "b", None}  # the null source is one of its own
    assert mixing.mix(none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": -1.0})
