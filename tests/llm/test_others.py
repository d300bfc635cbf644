"""Neighbours, pages, chats, components, the registry and the pipeline."""

import json
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import hnsw, html_text, tool_calls
from quarry.llm.components import components
from quarry.llm.queries import ORACLE, REGISTRY

SF = "/root/testdata/sf0.001"


def test_components_against_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    found = dict(components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert found == {x: top(x) for x in up if x in found}
    assert {x for a, b in pairs if a != b for x in (a, b)} == set(found)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 500)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).round(3)
    x[100:500] = x[100]  # a hot vector
    rows = [(int(i), [float(c) for c in v], 1) for i, v in enumerate(x)]
    bad = [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [None] + [1.0] * 15, 1),
           (5200, [float("inf")] * 16, 1), (5250, [], 1), (None, [1.0] * 16, 1), (5300, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + rows[:20] + bad, "vec_id long, embedding array<double>, width int")
    found = {}
    for r in hnsw.nearest(table, every=50, k=5).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(range(0, 1500, 50))  # 5300 has no other row of its width
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, got in found.items():
        cos = unit @ unit[q]
        order = [int(i) for i in np.lexsort((np.arange(1500), -cos.round(12))) if i != q][:5]
        assert sorted(got) == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(cos[i], abs=1e-12) for i, s in got.values())
        hits += len({i for i, _ in got.values()} & set(order))
    assert hits / (5 * len(found)) >= 0.9
    assert [found[150][k][0] for k in range(1, 6)] == [100, 101, 102, 103, 104]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, width int")
    assert hnsw.nearest(few, every=50).count() == 2 and hnsw.nearest(few.limit(0)).count() == 0


def test_queries_meet_shards_without_a_broadcast(spark, monkeypatch):
    """Blocks of queries are few and large: Spark takes them for small ones, and
    one copy for each shard filled the driver's memory."""
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 60)
    monkeypatch.setattr(hnsw, "BLOCK", 4)
    rng = np.random.default_rng(5)
    x = [rng.normal(size=8 if i % 5 else 3).round(3) for i in range(400)]
    found = hnsw.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=20, k=3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in found.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()  # after the run: as it ran
    assert "Broadcast" not in plan and "Generate" not in plan
    assert set(got) == {(q, k) for q in range(0, 400, 20) for k in (1, 2, 3)}
    for q in range(0, 400, 20):  # graphs of so few vectors are searched whole
        cos = {i: v @ x[q] / np.linalg.norm(v) / np.linalg.norm(x[q]) for i, v in enumerate(x) if len(v) == len(x[q]) and i != q}
        order = sorted(cos, key=lambda i: (-cos[i], i))[:3]
        assert [got[q, k][0] for k in (1, 2, 3)] == order
        assert all(got[q, k][1] == pytest.approx(cos[i], abs=1e-12) for k, i in enumerate(order, 1))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script><style>p{{}}</style></head><body>
<header><h1>Site</h1></header><nav><a href="/">Home</a> <a href="/x">Other things to read</a></nav>
<div class="cookie-notice">We use cookies on this site, as everybody does nowadays.</div>{body}
<aside>Aside text that is long enough to matter, at least to some readers.</aside>
<form><label>Mail</label><input name=q><button>Send</button></form>
<section id="comments"><p>First! A comment that is really long, longer than most of the text, and goes on and on.</p></section>
<footer>&copy; somebody</footer></body></html>"""


@pytest.mark.parametrize("body, text", [
    ("<article><h2>Head</h2><p>One  two\n three, four five.</p><p>a &lt;b&gt; &eacute;&#33;<br>next</p></article>",
     "Head\nOne two three, four five.\na <b> é!\nnext"),
    ("<div id=content><h2>Head</h2><p>Some words that make a paragraph.<p>Another one, not closed.<ul><li>i1<li>i2</ul></div>",
     "Head\nSome words that make a paragraph.\nAnother one, not closed.\ni1\ni2"),
    ("<main><div><p>First part of the text, with words.</p><p>More of it.</p></div><div><p>Second part.</p></div></main>",
     "First part of the text, with words.\nMore of it.\nSecond part."),
    ("", ""),
])
def test_main_text(body, text):
    if text:
        assert html_text.main_text(PAGE.format(body=body)) == text


LONG = "<p>A paragraph of the text itself, with quite a few words in it.</p><p>And another one, about as long as the first.</p>"
PLAIN = "A paragraph of the text itself, with quite a few words in it.\nAnd another one, about as long as the first."


@pytest.mark.parametrize("page, text", [
    (f'<div class="content has-sidebar">{LONG}</div>', PLAIN), (f'<article class="post no-comments">{LONG}</article>', PLAIN),
    (f'<main id="search-guide">{LONG}</main><div class="site-footer">Some words below.</div>', PLAIN),
    (f"<form><div>{LONG}</div><button>Send</button></form>", PLAIN), (f'<div class="widget">{LONG}</div><nav>Start</nav>', PLAIN),
    (f"<main><article>{LONG}</article><article><p>A second part, shorter.</p></article><p><a href=x>Other</a></p></main>",
     PLAIN + "\nA second part, shorter."),
    (f"<main><h1>Head</h1><div><article>{LONG}</article></div><div><article>{LONG}</article></div></main>",
     f"Head\n{PLAIN}\n{PLAIN}"),
    (f"<div><article>{LONG}</article><article>{LONG}</article></div>", f"{PLAIN}\n{PLAIN}"),
    (f'<div><div class="cookie-notice">We use cookies.</div>{LONG}<div id="comments">First!</div></div>', PLAIN),
])
def test_main_text_is_whole(page, text):
    assert html_text.main_text(f"<html><body><nav><a href=/>Home</a></nav>{page}</body></html>") == text


def test_pages(spark):
    html = ["<p>x", None, "", "no markup at all", "<p>cut <b>off</b> <a href='", "<p>" * 2000 + "deep", "<!-- c --><p>a<!--", "&amp;"]
    table = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(html)], "page_id long, url string, html string, text string")
    rows = {r.page_id: r.text for r in html_text.extract(table).collect()}
    assert [rows[i] for i in range(len(html))] == ["x", "", "", "no markup at all", "cut off", "deep", "a", "&"]
    assert all(r.n_chars == len(r.text) for r in html_text.extract(table).collect())
    assert html_text.extract(table.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 1, "call", "a", "search", '{"words":3, "query":"x","after":"b"}'), (1, 2, "result", "a", None, "ok"),
            (1, 5, "call", "b", "lookup", '{"query":1,"words":2.5,"zz":{"b":1,"a":[1, 2]}}'), (1, 6, "result", "b", None, None),
            (2, 1, "call", "a", "search", '{"after":"c"}'), (2, 2, "call", "c", "nope", '{"after":["a"]}'),
            (2, 3, "call", None, "note", "{bad"), (2, 4, "result", "q", None, "z"), (2, 5, "call", "a", "note", "[1]"),
            (None, 1, "call", "x", "note", '{"query":"é\\n"}'), (3, None, "message", "u", "user", None)]
    schema = "conv_id long, turn int, kind string, call_id string, name string, body string"
    table = spark.createDataFrame([(*r, "c") for r in rows], schema + ", calls string")
    found = {(r.conv_id, r.kind, r.turn): r for r in tool_calls.format_chat(table, tool_calls.TOOLS).collect()}
    assert len(found) == len(rows)
    places = [found[1, k, t].place for k, t in (("call", 5), ("result", 6), ("call", 1), ("result", 2))]
    assert places == [5, 6, 7, 7] and found[1, "call", 1].linked
    assert found[1, "call", 5].errors == "missing exact; query is no string; unknown zz"
    assert found[1, "call", 5].json == ('{"arguments":{"query":1,"words":2.5,"zz":{"a":[1,2],"b":1}},"call_id":"b",'
                                        '"kind":"call","name":"lookup","turn":5}')
    assert found[2, "call", 1].errors == "repeated; no result; cyclic; missing query; missing words"
    assert found[2, "call", 2].errors == "no result; cyclic; unknown tool"
    assert found[2, "call", 3].errors == "no identifier; malformed arguments"
    assert found[2, "result", 4].errors == "no call" and found[None, "call", 1].errors == "no identifier"
    assert json.loads(found[None, "call", 1].json)["arguments"]["query"] == "é\n"
    assert found[3, "message", None].json == '{"kind":"message","name":"user"}'
    assert tool_calls.format_chat(table.limit(0), tool_calls.TOOLS).count() == 0


def test_places_of_long_chains_and_cycles(spark):
    rng = random.Random(3)
    graphs = {1: {k: [k + 1] for k in range(40)} | {40: []},  # each waits for the next
              2: {k: [k + 1] for k in range(39)} | {39: [0], 40: [39, 41], 41: [], 42: [41]},  # a cycle in turn order
              3: {k: [k + 1, k + 2] for k in range(6)} | {6: [], 7: []}, 4: {0: [0], 1: [0], 2: [9]}}
    for g in range(5, 30):
        n = rng.randint(2, 12)
        graphs[g] = {k: rng.sample(range(n), rng.choice([0, 1, 1, min(n, 2)])) for k in range(n)}
    end, rows, want = {}, [], {}
    for g, waits in graphs.items():
        for k in waits:
            end[g, k] = rng.choice([None, k, k + 1, k + 9])
            rows.append((g, str(k), k, end[g, k], [str(w) for w in waits[k]]))
        place, open_ = {}, dict(waits)
        while ready := [k for k, ws in open_.items() if not any(w in open_ for w in ws)]:
            for k in ready:
                place[k] = max([k, *(max(place[w], w if end[g, w] is None else end[g, w]) + 1 for w in waits[k] if w in place)])
                del open_[k]
        want |= {(g, str(k)): (place.get(k, k), k in open_) for k in waits}
    table = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, end long, waits array<string>")
    assert {(r.conv_id, r.call_id): (r.place, r.cyclic) for r in tool_calls.places(table).collect()} == want


def test_chat_of_conversations_is_in_order(spark):
    rows = REGISTRY["op2_tool_call_linking"](spark, SF).collect()
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    calls = [t for t in turns if t.role == "assistant"]
    results = [t for t in turns if t.role == "user" and t.turn > 0]
    assert len(rows) == len(turns) + len(calls) + len(results)
    called = {(t.conv_id, t.turn) for t in calls}
    assert sum(r.linked for r in rows if r.kind == "result") == sum((t.conv_id, t.turn - 1) in called for t in results)
    place = {(r.conv_id, r.call_id): r.place for r in rows if r.kind == "call"}
    for r in rows:
        text = json.loads(r.json)
        assert r.json == json.dumps(text, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if r.kind == "call" and (r.conv_id, text["arguments"].get("after")) in place:
            assert r.place > place[r.conv_id, text["arguments"]["after"]]


def test_registry():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in REGISTRY) == 1
    assert set(ORACLE) <= set(REGISTRY)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "byte_bpe"]


def test_mixing_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    mine = REGISTRY["op5_mix_sources"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    theirs = con.sql(ORACLE["op5_mix_sources"]).df().sort_values("doc_id").reset_index(drop=True)
    assert mine.equals(theirs)


def test_pipeline(spark):
    before = spark.read.parquet(f"{SF}/documents.parquet")
    docs = before
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = function(spark, docs, SF)
        assert docs.columns == before.columns
    rows = corpus_pipeline.run(spark, SF).collect()
    left = [r.doc_id for r in docs.collect()]
    assert sorted(r.doc_id for r in rows) == sorted(left) and set(left) < {r.doc_id for r in before.collect()}
    assert all(left.count(i) in (1, 2) for i in set(left))


def test_pipeline_stages_on_hard_cases(spark, docs, none):
    for table in (docs, none):
        for name, function in corpus_pipeline.STAGES:
            table = function(spark, table, SF)
            if name != "byte_bpe":
                assert table.columns == docs.columns
        table.collect()


def test_pages_with_many_open_tags_take_linear_time():
    began = time.time()
    assert html_text.main_text("<b><p>x</p>" * 90_000).count("\n") == 89_999
    assert html_text.main_text("<div><span>" * 50_000 + "text") == "text"
    assert time.time() - began < 60
