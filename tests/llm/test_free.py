"""Operators with numpy inside tasks: join, repeats, decontamination, tokens, wrappers, and the pipeline."""

import hashlib
import random
import time

import brute
import numpy as np
import pyarrow as pa
import pytest

from veriloom.llm import decontaminate, graph, jaccard, repeats, shingling, token_shards, wrappers
from veriloom.llm.fm_index import FMIndex, suffix_order


def words(seed, n, vocabulary=5000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# ------------------------------------------------ digests


def test_words_are_cut_at_blanks_and_texts():
    column = pa.array(["Ab cd", None, "", " x\x0by ", " é z", "ab"])
    (_, data, offsets), = shingling.chunks(column)
    digest, first = shingling.words(data, offsets, shingling.BLANK)
    assert first.tolist() == [0, 2, 2, 2, 4, 6, 7]
    assert digest[0] == digest[6] and len(set(digest.tolist())) == 6


def test_digests_do_not_depend_on_place():
    data = np.frombuffer(b"abcdefabcdef", np.uint8)
    sums = shingling.prefix_sums(data)
    got = shingling.ranges(sums, np.array([0, 6, 1]), np.array([6, 12, 7]))
    assert got[0] == got[1] != got[2]
    assert (shingling.rolling(sums, 6)[[0, 6, 1]] == got).all()


# ------------------------------------------------ join


def near(seed):
    r, rows, n = random.Random(seed), [], 0
    for g in range(14):
        base = words((seed, g).__hash__(), r.choice([5, 6, 9, 12, 30, 120, 400]))
        for _ in range(r.choice([1, 2, 5, 12])):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 25) + 1)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    rows += [(n, " ".join(words(7, 60) + base)) for n, base in enumerate([words(k, 60) for k in range(12)], n)]
    return rows


@pytest.mark.parametrize("long_list", [64, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_join_against_all_pairs(table, odd, monkeypatch, seed, long_list):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rows = near(seed)
    want = brute.jaccard(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_copies(table(rows)).collect()}
    assert got == want


def test_join_of_odd_rows(table, odd):
    got = jaccard.near_copies(table(odd)).collect()
    assert len(got) == len(odd)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == r["doc_id"] and (r["n_shingles"] == 0) == (r["doc_id"] in (1, 2, 3))
    kept = jaccard.keep_one(table(odd)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "5", "6", "None"]
    assert jaccard.near_copies(table([])).count() == 0 and jaccard.keep_one(table([])).count() == 0


def test_both_ways_of_fetching_texts_agree(table, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = near(3)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(table(rows)).collect()} == {i: c for i, (_, c) in brute.jaccard(rows).items()}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 103), (103, 101), (7, 7)]
    out = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(1, 41)}, 101: 100, 103: 100}


# ------------------------------------------------ repeats


def passages(seed):
    r = random.Random(seed)
    alphabet = "abé \U0001f600"
    long = ["".join(r.choice(alphabet) for _ in range(r.randrange(30, 90))) for _ in range(4)]
    rows = []
    for i in range(14):
        parts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60)))]
        for _ in range(r.randrange(3)):
            parts += [r.choice(long), "".join(r.choice(alphabet) for _ in range(r.randrange(0, 50)))]
        rows.append((i, "".join(parts)))
    return [*rows, (14, "z" * 300), (15, rows[3][1]), (16, None), (17, "")]


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_against_all_windows(table, hot, keep_first):
    rows = passages(5)
    out = repeats.remove_repeats(table(rows), length=40, gram=12, hot=hot, keep_first=keep_first).orderBy("doc_id").collect()
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out]
    want = brute.repeats(rows, 40, keep_first)
    if keep_first and hot == 1:
        # Runs of one letter: which of its own windows is first depends on the run they are counted in.
        got[14], want[14] = None, None
    assert got == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out)


def test_repeats_of_odd_rows(table, odd):
    out = repeats.remove_repeats(table([(i, t, 1) for i, t in odd], "doc_id long, text string, N_Bytes int"))
    rows = out.collect()
    assert len(rows) == len(odd) and [c.lower() for c in out.columns].count("n_bytes") == 1
    assert {r["doc_id"]: r["n_removed"] for r in rows}[5] == 25000
    assert repeats.remove_repeats(table([])).count() == 0


def test_repeats_of_many_rows_without_id(table):
    r = random.Random(3)
    letters = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    long = [letters(60) for _ in range(4)]
    rows = [(None if k % 2 else 7, letters(r.randrange(60)) + r.choice(long) + letters(r.randrange(60))) for k in range(1000)]
    rows += rows[:40]
    out = repeats.remove_repeats(table(rows), length=40, gram=12).collect()
    got = sorted((x["text"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in out)
    assert got == sorted((t, *w) for (_, t), w in zip(rows, brute.repeats(rows, 40)))


def test_previous_factors():
    text = b"abracadabra_abracadabra"
    data = np.frombuffer(text + bytes(4), np.uint8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = repeats.suffix_ranks(padded, 8)
    starts = np.arange(len(text) - 7)
    earlier, twin = repeats.previous_factors(rank, starts)
    want = [text.find(text[s : s + 8]) < s for s in starts]
    assert earlier.tolist() == want and twin.tolist() == [text.count(text[s : s + 8]) > 1 for s in starts]
    assert repeats.nearest_smaller(np.array([3, 1, 4, 0, 5, 2])).tolist() == [-1, -1, 1, -1, 3, 3]


# ------------------------------------------------ decontamination


def test_index_finds_every_occurrence():
    r = np.random.default_rng(3)
    seq = r.integers(0, 4, 400)
    index = FMIndex(seq, 4)
    assert sorted(suffix_order(seq), key=lambda i: seq[i:].tolist()) == suffix_order(seq).tolist()
    for size in (1, 2, 5):
        table = r.integers(1, 4, (20, size))
        low, high = index.search(table)
        for row, a, b in zip(table, low, high):
            want = [i for i in range(len(seq) - size + 1) if (seq[i : i + size] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_small_shards_find_the_same(monkeypatch):
    items = [("a", " ".join(words(1, 30, 9))), ("b", "w1 w2")]
    phrases = decontaminate.Phrases(items, 4)
    names = ["text", "spans", "items"]
    texts = [" ".join(words(k, 60, 9)) for k in range(8)] + ["", items[0][1]]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([[]] * 10, pa.list_(decontaminate._SPAN)), pa.array([[]] * 10, pa.list_(pa.string()))], names)
    results = []
    for most in (10**6, 20):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", most)
        (out,) = decontaminate._search(phrases, names)([batch])
        covered = [sorted({p for s in row for p in range(s["start"], s["stop"])}) for row in out.column(1).to_pylist()]
        results.append((covered, out.column(2).to_pylist()))
    assert results[0] == results[1] and any(results[0][0])


@pytest.mark.parametrize("block_words", [10**6, 30])
def test_decontamination_against_search(table, odd, block_words):
    items = [(k, " ".join(words(k, n, 50))) for k, n in enumerate([25, 12, 10, 4, 1, 0, 30])] + [(7, None), (1, "Extra, words: for one ITEM!")]
    rows = [(10 + k, " ".join(words(90 + k, 30, 50) + items[k % 7][1].split() + words(70 + k, 9, 50)).replace(" w1", ", W1")) for k in range(20)] + odd[:-2] + odd[-1:]
    out = decontaminate.decontaminate(table(rows), table(items, "item_id long, text string"), block_words=block_words).collect()
    want = brute.contamination(rows, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in out} == want
    for r in out:
        if not r["contaminated"]:
            assert r["clean_text"] == (dict(rows)[r["doc_id"]] or "")
    assert any(r["contaminated"] for r in out)
    empty = table([], "item_id long, text string")
    assert decontaminate.decontaminate(table(rows), empty).where("contaminated").count() == 0
    assert decontaminate.decontaminate(table([]), table(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("block_words", [10**6, 20])
def test_items_without_id_are_searched(table, block_words):
    items = [(None, " ".join(words(1, 15, 50))), (None, " ".join(words(2, 14, 50))), (3, " ".join(words(3, 12, 50)))]
    rows = [(1, f"before {items[0][1]} after"), (2, f"{items[1][1]} {items[2][1]} {items[0][1]}"), (3, items[2][1]), (4, "clean")]
    out = decontaminate.decontaminate(table(rows), table(items, "item_id long, text string"), block_words=block_words).collect()
    assert {r["doc_id"]: (r["n_hit"], r["items"], r["contaminated"]) for r in out} == {
        1: (15, [None], True), 2: (41, ["3", None], True), 3: (12, ["3"], True), 4: (0, [], False)
    }


# ------------------------------------------------ tokens


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = token_shards.permute(np.arange(n), n, 5)
    assert sorted(slots.tolist()) == list(range(n))
    assert (token_shards.permute(slots, n, 5, back=True) == np.arange(n)).all()


def test_token_round_trip(table, odd, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(token_shards, "BLOCK_DOCS", 7)
    rows = texts[:40] + [(1000 + k, t) for k, (_, t) in enumerate(odd)] + [(2000, "same"), (2000, "same"), (None, "no id")]
    shards = token_shards.token_shards(table(rows), length=64, rows=32)
    out = shards.collect()
    assert [r["slot"] for r in out] == list(range(len(out))) and all(r["shard"] == r["slot"] // 32 and r["row"] == r["slot"] % 32 for r in out)
    assert sorted(r["number"] for r in out) == list(range(len(out)))
    made, end = token_shards.encoder(token_shards.VOCABULARY)
    by_number, got, current = sorted(out, key=lambda r: r["number"]), [], []
    for r in by_number:
        ids = np.frombuffer(r["record"], "<u2")
        assert len(ids) == 64 and (ids[r["n_tokens"] :] == end).all()
        current += ids[: r["n_tokens"]].tolist()
        if current[-1] == end:
            got.append((r["doc_id"], made.decode(current[:-1])))
            current = []
    assert sorted(map(str, got)) == sorted(map(str, [(i, t or "") for i, t in rows]))
    written = {r["shard"]: r["rows"] for r in token_shards.write_files(shards, tmp_path.as_uri()).collect()}
    k = len(out) - 1
    raw = (tmp_path / f"shard-{k // 32:05d}.bin").read_bytes()[(k % 32) * 128 : (k % 32 + 1) * 128]
    assert raw == bytes(out[k]["record"]) and sum(written.values()) == len(out)
    assert token_shards.token_shards(table([])).count() == 0


# ------------------------------------------------ wrappers

PAGE = """<html><head><title>t</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<ul class="menu"><li>A</li><li>B</li></ul><main><article><header><h1>My &amp; title {k}</h1></header><p>One<br>two &nbsp; <b>three</b></p>
<div class="ad">buy</div><aside>side</aside><form><input>f</form><ul><li>x{k}<li>y</ul>{more}<script>if(a<b){{}}</script></article>
<section id="comments"><p>nice!</p></section></main><footer>c</footer></body></html>"""


def test_main_text(table):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE.format(k=k, more="<p>more</p>" * (k % 3))) for k in range(12)]
    rows += [(20, None, None), (21, "x", ""), (22, "http://u", "<p>only"), (22, "http://u", "<p>only"), (23, "http://d", "<div>" * 3000 + "deep")]
    pages = table([(*r, "old") for r in rows], "page_id long, url string, html string, TEXT string")
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrappers.extract(pages).collect()}
    for k in range(12):
        text = "\n".join([f"My & title {k}", "One two three", f"x{k}", "y"] + ["more"] * (k % 3))
        assert out[k] == (text, len(text))
    assert out[20] == out[21] == ("", 0) and out[22] == ("only", 4) and out[23] == ("deep", 4)
    assert wrappers.extract(table([], "page_id long, url string, html string")).count() == 0


def test_expressions_align():
    a, b = wrappers.parse("<body><p>1<p>2<div class='x7'>k</div></body>"), wrappers.parse("<body><h2>t</h2><p>1</body>")
    w = wrappers.Wrapper()
    for tree in (a, b):
        w.add(tree)
    assert wrappers.written(w.seq) == "<body>(<h2>#text</>)?(<p>#text</>)+(<div.x>#text</>)?</>"
    rows = wrappers.parse("<body><h2>a</h2><p>b</p><h2>c</h2><p>d</p></body>")
    w = wrappers.Wrapper()
    w.add(rows)
    assert wrappers.written(w.seq) == "<body>(<h2>#text</><p>#text</>)+</>"


def test_names_within_an_article_drop_no_sections():
    names = ["discussion", "related-work", "side-effects", "search-methods", "comments-on-x", "share-prices"]
    parts = "".join(f"<section id='{n}' class='discussion'><h2 id='h-{n}'>t {n}</h2><p id='p-{n}'>b {n}</p></section>" for n in names)
    page = "<body><div id='side-x'>menu</div>{}<div class='ad'>buy</div><div role='complementary'>c</div>{}</body>"
    want = "\n".join(f"t {n}\nb {n}" for n in names)
    for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("<main><section id='comments'>c</section><article>", "</article></main>")):
        assert wrappers.main_text(wrappers.parse(page.format(a + parts, b)), frozenset()) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><form id=aspnetForm><div class=content><p>Hello real text</p></div></form></body>", "Hello real text"),
        ("<body><form><p>Hello real text</p></form></body>", "Hello real text"),
        ("<body><article><p>Text</p>%s</article></body>", "Text"),
        ("<body><article><p>Other story</p></article><div class='post-body'><p>The story itself, much longer than the teaser</p></div></body>",
         "The story itself, much longer than the teaser"),
        ("<body><form class=search><input></form><article><p>Text</p></article></body>", "Text"),
    ],
)
def test_forms_comments_and_teasers(page, want):
    added = ["<section class=comments><p>nice</p></section>", "<div id=comments><p>nice</p></div>", "<ol class=comment-list><li>nice</ol>",
             "<div class=share-buttons>tell</div>", "<div class=related-posts><p>more</p></div>"]
    for part in added if "%s" in page else [""]:
        assert wrappers.main_text(wrappers.parse(page.replace("%s", part)), frozenset()) == want


def test_template_slots_go(table):
    page = "<body><div><p>Always here</p></div><section><h3>{k}</h3></section></body>"
    rows = [(k, "http://h.org/", page.format(k=f"text {k}")) for k in range(6)]
    out = {r["page_id"]: r["text"] for r in wrappers.extract(table(rows, "page_id long, url string, html string")).collect()}
    assert out == {k: f"text {k}" for k in range(6)}


def test_copies_of_one_article_are_no_template():
    page = "<body><div>{clock}</div><article><h1>{k}</h1>{more}<footer>f</footer><div><p>Always</p></div></article></body>"
    w, half = wrappers.Wrapper(), wrappers.Wrapper()
    quote = "<blockquote>only here</blockquote>"
    sources = [page.format(k=k, clock=k, more="") for k in range(6)] + [page.format(k="one", clock=k, more=quote) for k in range(20)]
    for n, source in enumerate(sources):
        (w, half)[n % 2].add(wrappers.parse(source))
    w.join(wrappers.Wrapper.load(half.dump()))
    assert wrappers.main_text(wrappers.parse(sources[-1]), frozenset(w.template())) == "one\nonly here"


# ------------------------------------------------ pipeline


def test_pipeline(spark, folder):
    import corpus_pipeline

    from veriloom.llm import quality, sharding

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    one = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, folder).collect()}
    assert set(one) == {r["doc_id"] for r in quality.judge_lines(docs).where("kept").collect()}
    best = brute.jaccard(sorted(one.items()))
    two = corpus_pipeline.near_copies(spark, spark.createDataFrame(sorted(one.items()), "doc_id long, text string"), folder)
    assert {r["doc_id"] for r in two.collect()} == {c for _, c in best.values()}
    hit = brute.contamination(sorted(one.items()), benchmark)
    three = corpus_pipeline.decontaminated(spark, spark.createDataFrame(sorted(one.items()), "doc_id long, text string"), folder)
    for r in three.collect():
        assert (r["text"] == one[r["doc_id"]]) == (hit[r["doc_id"]][1] == 0)
        left = brute.WORD.findall(brute.lowered(r["text"]))
        assert len(left) == hit[r["doc_id"]][0] - hit[r["doc_id"]][1]
    out = corpus_pipeline.run(spark, folder)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {c for _, c in best.values()}
    assert out.columns == [*docs.columns, *sharding.RESULT]
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_op7_sorts_postings_in_small_tasks_and_leaves_no_shuffle_files(spark, monkeypatch):
    from veriloom import session
    from veriloom.llm import jaccard

    texts = [(n, " ".join(f"w{(n // 4 * 31 + k * k) % 211}" for k in range(40 + n % 4))) for n in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return session.through_table(df, name)

    monkeypatch.setattr(jaccard, "through_table", kept)
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", 100)
    total = sum(r["n_shingles"] for r in jaccard.near_copies(docs).collect())
    assert f"{-(-total // 100)}), REPARTITION_BY_NUM" in plans["lists"]
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffle_files():
        files = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles())
        return {f.getName() for f in files if f.getName().startswith("shuffle_")}

    before = shuffle_files()
    counted = session.through_table(docs.repartition(3, "text").groupBy("doc_id").count(), "counted")
    for _ in range(50):
        if shuffle_files() <= before:
            break
        time.sleep(0.1)
    assert shuffle_files() <= before and counted.count() == 12
