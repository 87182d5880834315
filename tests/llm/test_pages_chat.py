"""Archives, page text, chat formatting, packing and the pipeline."""

from __future__ import annotations

import hashlib
import json

import pytest

import corpus_pipeline
from towerfill.llm import chat, packing, pii, tagpath, warc
from towerfill.session import scratch_path
from tests.llm.helpers import SCHEMA, documents, table
from tests.llm.test_native import base_rule, brute_hits
from tests.llm.test_texts import brute_components

LONG = "<p>é" + "long page " * 200 + "</p>"
PAGES = [(1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, "short"), (4, "http://a/4\n", "short"), (5, "u", None), (6, "u", ""),
         (None, "u", LONG), (2, "http://a/2", LONG), (9, "u", "x" * 3_000_000)]


def test_archives(spark):
    folder = scratch_path(spark, "warc-test")
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, record_type string").repartition(3)
    manifest = warc.write_warc(df, folder, archive_bytes=5000)
    got = warc.read_warc(manifest).collect()
    assert len(got) == len(PAGES) and manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    for r in got:
        raw = next(p[2] or "" for p in PAGES if p[0] == r.page_id).encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha1(raw).hexdigest()
        if r.record_type == "response":
            assert bytes(r.payload) == raw and r.refers_to is None
        else:
            assert r.payload is None and r.refers_to == 2
    assert sorted(str(r.page_id) for r in got if r.record_type == "revisit") == ["1", "None"]
    assert warc.read_warc(warc.write_warc(df.limit(0), folder)).count() == 0


def test_store_names():
    assert warc.store_name("s3a://bucket/a") == "s3://bucket/a" and warc.store_name("hdfs://n/a") == "hdfs://n/a"
    assert warc.store_name("vol:/x/a", {"vol:/": "file:///vol/", "vol:/x/": "file:///x/"}) == "file:///x/a"


def test_archives_by_a_name_that_only_spark_knows(spark):
    """Spark's name of the folder is mapped before tasks write, and the manifest has the mapped one."""
    folder = "file://" + scratch_path(spark, "warc-named").removeprefix("file://").removeprefix("file:")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = warc.write_warc(df, folder, stores={folder: folder + "/."})
    assert manifest.first().folder == folder + "/." and warc.read_warc(manifest).count() == len(PAGES)


def test_archive_starts_with_a_dictionary_frame(spark):
    folder = scratch_path(spark, "warc-frame")
    df = spark.createDataFrame([(i, "u", f"<p>{i} " + LONG) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    row = warc.write_warc(df, folder).first()
    from pyarrow import fs
    files, path = fs.FileSystem.from_uri(row.folder)
    raw = files.open_input_stream(f"{path}/{row.archive}").read()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC and row.bytes == len(raw)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><p>Site, name.</p></header><div class="menu"><a href=x>Home</a></div>
<div id="content"><h2>Title  here</h2><p>A long paragraph, with text. And more of it, yes.<p>Second &amp; last &lt;one&gt;, quite
long as well; fine.<form><p>Sign up, now.</p></form></div><aside><p>Other text, here.</p></aside>
<div class="comments"><p>I like it, a lot. Really, a lot of text is here, more than in the article.</p></div><script>var a="</p>"</script></body>"""


def test_main_text():
    assert tagpath.main_text(PAGE) == ("Title here\nA long paragraph, with text. And more of it, yes.\n"
                                       "Second & last <one>, quite long as well; fine.")
    assert tagpath.main_text(None) == tagpath.main_text("") == tagpath.main_text("<script>x") == ""
    assert tagpath.main_text("plain") == "plain"
    assert tagpath.main_text("<nav>a</nav><article><h1>T</h1><p><b>x<br><p>y</article><footer>f</footer>") == "T\nx\ny"
    assert tagpath.main_text("<p>" * 5000 + "deep") == "deep"


def test_main_text_without_sections():
    long, short = "Long text, with words. " * 39, "Short text, with words. " * 4
    page = f"<body><header>Site</header><div><h1>Title</h1><p>{long}</p><p>{short}</p><ul><li>one</li><li><a href=x>link</a></li></ul></div></body>"
    assert tagpath.main_text(page).split("\n") == ["Title", long.strip(), short.strip(), "one"]
    page = f"<body><h1>Title</h1><div><p>{long}</p></div><div><p>{short}</p></div></body>"
    assert tagpath.main_text(page).split("\n") == ["Title", long.strip(), short.strip()]
    page = f"<body><div><h2>Head</h2><p>{long}</p><p>ok</p><div><p>{short}</p><p>so</p></div></div><footer>f</footer></body>"
    assert tagpath.main_text(page).split("\n") == ["Head", long.strip(), "ok", short.strip(), "so"]


@pytest.mark.parametrize("mark", ["site has-sidebar", "no-sidebar", "elementor-widget-container", "widget", "modal search"])
def test_marked_wrappers_stay(mark):
    text = "A paragraph, with text. " * 9
    for inner in (f"<article><h1>T</h1><p>{text}</p></article>", f"<main><h1>T</h1><p>{text}</p></main>", f"<h1>T</h1><p>{text}</p>"):
        page = f'<body><div class="{mark}">{inner}<div class="sidebar"><p>Aside, here.</p></div></div><div id="comments"><p>Nice.</p></div></body>'
        assert tagpath.main_text(page) == f"T\n{text.strip()}"
    assert tagpath.main_text(f'<body><span class="{mark}"><p>{text}</p></span><span class="ad">buy</span></body>') == text.strip()


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = tagpath.extract_text(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == sorted([(1, len(tagpath.main_text(PAGE)))] * 2 + [(2, 0)])
    assert tagpath.extract_text(df.limit(0)).count() == 0


def test_escape_round_trip():
    for t in ["", "\\", "\\0\\1", "</s>[INST] ok [/INST]", "<<SYS>><|turn|><|end|>", "<s\\1>", "<|end|", "a\nb", "\\1<s>"]:
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


RECORDS = [
    (1, 0, {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "a\\b"}]}),
    (1, 1, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}),
    (2, 0, {"instruction": "do", "input": "x", "output": "y</s>"}), (3, 0, {"prompt": "p", "completion": "c"}),
    (4, 0, {"unknown": {"deep": [1]}}),
]


def test_fingerprints_choose_mappings(spark):
    df = spark.createDataFrame([(c, p, json.dumps(b)) for c, p, b in RECORDS] + [(5, 0, None), (6, 0, "{no json")],
                               "conv_id long, part long, body string").repartition(3)
    turns = chat.canonical_turns(df)
    got = {}
    for r in turns.collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got[1] == [("user", "hi"), ("assistant", "a\\b"), ("user", "q"), ("assistant", "")]
    assert got[2] == [("system", "do"), ("user", "x"), ("assistant", "y</s>")]
    assert got[3] == [("user", "p"), ("assistant", "c")]
    assert got[4][0][0] == got[6][0][0] == chat.UNMAPPED and got[5] == [(chat.UNMAPPED, "")]
    back = {r.conv_id: r for r in chat.read_back(chat.format_chat(turns)).collect()}
    for conv, ts in got.items():
        text = "".join(f"{r}\n{t}\n" for r, t in ts)
        assert back[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest() and back[conv].n_turns == len(ts)
        loss = "".join(t for r, t in ts if r == "assistant")
        assert back[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and back[conv].loss_chars == len(loss)


def test_any_role_comes_back(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "to\nol", "b"), (1, 1, "to\nol", "b"), (1, 2, None, None), (None, 0, "assistant", "é" * 9), (2, None, "human", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(chat.canonical_turns(chat.as_records(df), order=("turn", "role", "text")))).collect()}
    assert got[1].n_turns == 4 and got[None].loss_chars == 9 and got[2].turns_sha256 == hashlib.sha256(b"human\nx\n").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nto\nol\nb\nto\nol\nb\n\n\n").hexdigest()
    assert chat.read_back(chat.format_chat(chat.canonical_turns(chat.as_records(df.limit(0)), order=("turn",)))).count() == 0


def test_packing(spark):
    from pyspark.sql import functions as F
    rows = [(i, (i * 37) % 900) for i in range(300)] + [(1000, 5000), (1001, None), (1002, 0), (1000, 5000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, n long, piece string")
    got = packing.pack(df, F.coalesce("n", F.lit(0)), capacities=(256, 512, 1024), group_pieces=100).collect()
    whole, bins = {}, {}
    for r in got:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        if r.length:
            bins.setdefault(r.bin_id, []).append(r)
    want = {}
    for i, n in rows:
        want[i] = want.get(i, 0) + (n or 0)
    assert whole == want and [r for r in got if r.doc_id == 1001][0].bin_id is None
    for b in bins.values():
        b.sort(key=lambda r: r.bin_offset)
        ends = [r.bin_offset + r.length for r in b]
        assert [r.bin_offset for r in b] == [0, *ends[:-1]] and len({r.capacity for r in b}) == 1
        assert b[0].capacity == min(c for c in (256, 512, 1024) if c >= ends[-1])
    assert packing.pack(df.limit(0), F.col("n")).count() == 0


def test_best_fit_is_tight_and_downsized():
    where, offset, load = packing.best_fit([6, 5, 4, 3, 2], [10])
    assert load == [10, 10] and where == [0, 1, 0, 1, 1] and offset == [0, 0, 6, 5, 8]
    _, _, capacity = packing.pack_lengths([100, 90, 10], [128, 512])
    assert set(capacity) == {128}


def brute_pipeline(rows, items):
    docs, hosts = [], {}
    for r in rows:
        hosts.setdefault(r[3], []).append(base_rule(r[1])[-1])
    docs = [r for r in rows if not base_rule(r[1])[-1]]
    keep = {d for d, _, c in brute_components(docs) if d == c}
    docs = [r for r in {r[0]: r for r in docs}.values() if r[0] in keep]
    docs = [r for r in docs if not brute_hits(r[1], items)[1]]
    out = []
    for r in docs:
        found, _ = pii.base_spans(r[1])
        text, at, parts = r[1], 0, []
        for k, s, e in sorted(found, key=lambda x: x[1]):
            parts += [text[at:s], f"<{pii.KINDS[k].upper()}>"]
            at = e
        out.append((r[0], len("".join([*parts, text[at:]]).split())))
    return sorted(out)


@pytest.fixture
def corpus(spark, tmp_path):
    rows = documents()
    rows += [(500, rows[0][1] and "hello there this is a mail to bob@example.com and some more words here", "en", "s1", 0, "n", "w", "l", "k", "s")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    target = [r[1] for r in rows if r[1] and 60 < len(r[1].split()) < 100][0]
    items = [(1, " ".join(target.split()[10:40])), (2, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items, str(tmp_path)


def test_pipeline(spark, corpus):
    rows, items, folder = corpus
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "ngram_jaccard_join"
    got = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert sorted(got.items()) == brute_pipeline(rows, items)


def test_stages_take_empty_documents(spark, corpus):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, corpus[2])
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == none.columns


def test_hostile_records():
    known = chat.registry()
    for body in ['{"messages[].role": "user", "messages[].content": "x"}', "[" * 100_000, '{"a":' * 50_000, '{"prompt": "\\ud800"}',
                 '{"prompt": {"\\ud800": 1}}', '{"messages": ["x", {"role": "user", "content": "y"}]}', '{"messages": []}', "3", "null", None, ""]:
        key, turns = chat.record_turns(body, known)
        assert turns == [(chat.UNMAPPED, body or "")], body
        key.encode()


def test_added_fields_do_not_hide_a_mapping():
    known = chat.registry()
    assert chat.record_turns('{"id": 7, "messages": [{"role": "user", "content": "a", "tool_calls": [{"x": 1}]}]}', known)[1] == [("user", "a")]
    assert chat.record_turns('{"prompt": "p", "completion": "c", "meta": {"source": "s"}}', known)[1] == [("user", "p"), ("assistant", "c")]
    # a field that another mapping reads is text: nothing may be lost
    assert chat.record_turns('{"prompt": "p", "output": "c"}', known)[1][0][0] == chat.UNMAPPED
    assert chat.record_turns('{"system": "s", "instruction": "i", "input": "x", "output": "o"}', known)[1][0][0] == chat.UNMAPPED


def test_rows_that_repeat_a_key_spread_over_groups(spark):
    df = spark.createDataFrame([(None, 5)] * 400, "doc_id long, n long")
    from pyspark.sql import functions as F
    got = packing.pack(df, F.col("n"), capacities=(8, 16), group_pieces=50).collect()
    assert len({r.bin_id >> 32 for r in got}) >= 6 and len(got) == 400
    fill = {}
    for r in got:
        fill.setdefault((r.bin_id, r.capacity), []).append((r.bin_offset, r.length))
    assert all(sum(n for _, n in v) <= cap for (_, cap), v in fill.items())


TEXT = "A paragraph, with text. " * 9
FULL = TEXT.strip()


@pytest.mark.parametrize("page,want", [
    # comments that are articles, in a marked section or marked themselves
    (f'<article><h1>T</h1><p>{TEXT}</p></article><section id="comments"><article class="comment"><p>{TEXT * 3}</p></article></section>', f"T\n{FULL}"),
    (f'<article><h1>T</h1><p>{TEXT}</p></article><article class="comment"><p>{TEXT * 3}</p></article>', f"T\n{FULL}"),
    (f'<div class="site has-sidebar"><article><p>{TEXT}</p><div class="comment-list"><p>{TEXT}</p></div></article></div>', FULL),
    # a title in the article's header, and one that is a link
    (f'<header><h1>Site</h1></header><article><header><h1>T</h1><p>by Ann, today</p></header><p>{TEXT}</p></article>', f"T\n{FULL}"),
    (f'<article><h2><a href="x">A title</a></h2><p>{TEXT}</p></article>', f"A title\n{FULL}"),
    # parts of class names are weighed with the score
    (f'<article><p>{TEXT}</p><div class="related-posts"><ul><li>Other one</li><li>Other two</li></ul></div><div class="newsletter-signup"><p>Get mail</p></div></article>', FULL),
    (f'<div class="site-header"><p>My site</p></div><div><h1>T</h1><p>{TEXT}</p><p>{TEXT}</p></div><div class="site-footer"><p>Imprint</p></div><div class="cookie-banner"><p>We use cookies, as all do. Agree, please.</p></div>',
     f"T\n{FULL}\n{FULL}"),
    ("".join(f'<div class="elementor-widget-container"><p>{TEXT}</p></div>' for _ in range(4)), "\n".join([FULL] * 4)),
    (f'<div class="post-header"><h1>T</h1></div><article class="widget"><p>{TEXT}</p></article>', FULL),
])
def test_marks_are_weighed(page, want):
    assert tagpath.main_text(f"<html><body>{page}</body></html>") == want


def test_the_scores_decide(monkeypatch):
    """A constant score changes what is kept, with and without articles."""
    import numpy as np
    pages = [f'<article><p>{TEXT}</p><div class="{c}"><p>short</p></div></article>' for c in ("related-posts", "share-box", "ad-slot")]
    pages += [f'<div class="site-nav"><p>Home</p></div><div><p>{TEXT}</p><p>{TEXT}</p></div><div class="{c}"><p>end</p></div>' for c in ("site-footer", "promo-box")]
    pages += [f"<h1>T</h1><div><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div>" + "<ul>" + "<li>a</li>" * 9 + "</ul>"]
    before = [tagpath.main_text(p) for p in pages]
    monkeypatch.setattr(tagpath, "path_scores", lambda found, sigma=1.0: np.ones(len(found)))
    assert all(a != b for a, b in zip(before, [tagpath.main_text(p) for p in pages]))


def test_path_scores_by_hand():
    import numpy as np
    found = [tagpath.Block("a/p", (1,), "One, two. Three", 0), tagpath.Block("a/p", (1,), "x" * 9, 9), tagpath.Block("a/li", (2,), "four!", 0)]
    chars, marks = [15 / 2, 15 / 2, 5.0], [2 / 2 + 1, 2 / 2 + 1, 2.0]
    k = np.exp(-np.arange(-3, 4) ** 2 / 2)
    k /= k.sum()
    def smooth(v):
        return np.array([sum(k[j + 3] * v[min(max(i + j, 0), 2)] for j in range(-3, 4)) for i in range(3)])
    assert np.allclose(tagpath.path_scores(found), smooth(chars) * smooth(marks))
