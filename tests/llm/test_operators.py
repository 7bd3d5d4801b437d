"""The ten operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from packsieve.llm import components, exact_dedup, html_text, language_id, mixing, nearest, packing, scratch, seekable, shards, simhash, tokens, url_lists

SF = "/root/testdata/sf0.001"
#: Extra columns with the names of operators' own.
EXTRA = ["_salt", "kept", "row", "size", "start", "_text_key", "_id", "_len", "lang_pred", "_told", "fp", "_words", "block", "at"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA)
ODD = [None, "", " ", "a", "  two  spaces ", "tab\there\nline\n\nmore", "日本語 のテキスト", "<|endoftext|> as text", "x" * 300, "word | mark || pipes |", "İstanbul ſtraße", "é composed", "0 1 2 3.5 -7", "​ \x0b\x0c odd"]


def texts(n=60, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["the", "an", "er", "ti", "on", "é", "ß"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(n)]
    out += [out[0], out[0] + " ", out[1].replace(" ", "\n", 1), out[2] + " tail", " ".join(out)]  # copies, near copies, one long
    return ODD + out


def documents(spark, n=60):
    t = texts(n)
    rows = [(i, x, ["en", "fr", None][i % 3], [f"s{i % 4}", None][i % 9 == 8], len(x or ""), *[i] * len(EXTRA)) for i, x in enumerate(t)]
    rows += [rows[20], rows[20], (None, "no id", "en", "s0", 5, *[None] * len(EXTRA)), (None, t[15], "en", None, 5, *[0] * len(EXTRA))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library_ids(name, text):
    """What the tokenizers library gives for a text, its settings untouched."""
    ids = Tokenizer.from_file(tokens.vocabulary(name)).encode(text or "", add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_are_the_librarys(name, monkeypatch):
    e = tokens.Encoder(tokens.vocabulary(name))
    t = [x or "" for x in texts()]
    want = [library_ids(name, x) for x in t]
    assert e.encode(t) == want == e.encode(t[::-1])[::-1]
    monkeypatch.setattr(tokens, "CACHE_CHUNKS", 10)
    assert e.encode(t) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_spellings_of_added_tokens_get_their_ids(name):
    e, odd = tokens.Encoder(tokens.vocabulary(name)), ["a <|endoftext|> b", "x<|endoftext|>", "<|ENDOFTEXT|> a", "<|startoftext|> a b", "a <| endoftext|> b", "<|endoftext|><|endoftext|>", "plain a b", "a  <|endoftext|>\n b"]
    assert e.encode(odd) == [library_ids(name, x) for x in odd]
    assert len(e.encode([odd[0]])[0]) // 4 < len(e.encode(["a <|endoftex|> b"])[0]) // 4
    assert list(tokens.slices(["aa", "b", "cccc", "d"], 3)) == [(0, 2), (2, 3), (3, 4)]


def test_packing_holds_every_id_once(spark, docs, empty):
    rows = [r.asDict() for r in packing.pack(docs).collect()]
    want = Counter()
    for r in docs.collect():
        ids = library_ids("byte_bpe_50k.json", r.text) + (0).to_bytes(4, "little")
        want[r.doc_id, len(ids) // 4, tuple(zlib.crc32(ids[a : a + 4096]) for a in range(0, len(ids), 4096))] += 1
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert sum(r["length"] for r in rows) == sum(k[1] * n for k, n in want.items())
    for (doc_id, total, crcs), n in want.items():
        for k, crc in enumerate(crcs):
            assert sum(r["start"] == 1024 * k and r["ids_crc32"] == crc and r["doc_tokens"] == total for r in by[doc_id]) >= n
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 1
    assert packing.pack(empty).count() == 0


def test_plan_uses_the_histogram_exactly():
    rng = random.Random(1)
    h = Counter(rng.randint(1, 1023) for _ in range(5000))
    got = Counter()
    for p in packing.plan(dict(h)):
        assert sum(p.lengths) <= 1024
        for a in p.lengths:
            got[a] += p.repeats
    assert got == h
    used = sum(p.repeats for p in packing.plan(dict(h)))
    assert used <= 1.02 * sum(k * n for k, n in h.items()) / 1024 + 1
    assert packing.plan({}) == []
    # the solution itself places most remainders, in small and large corpora, and the plan's size doesn't follow the corpus
    for n in (1000, 200_000):
        lengths = np.exp(np.random.default_rng(1).normal(6, 1, n)).astype(int) % 1024
        h = np.bincount(lengths[lengths > 0], minlength=1025)
        patterns, rest = packing.plan({a: int(k) for a, k in enumerate(h) if k}), []
        with pytest.MonkeyPatch.context() as m:
            m.setattr(packing, "greedy", lambda left, window: rest.append(int(left.sum())) or [])
            packing.plan({a: int(k) for a, k in enumerate(h) if k})
        m = packing.SOLVED.index(0.8)
        assert max(rest[: m + 1]) <= 0.2 * h.sum()
        assert sum(p.repeats for p in patterns) <= 1.005 * (h * np.arange(1025)).sum() / 1024 + 1
        assert len(packing.places(patterns)[0]) <= packing.PLAN_ROWS
    combos = packing.combinations(np.array([2, 3, 5, 8, 10]), 10)
    assert {tuple(sorted(c[c > 0])) for c in combos} == {(10,), (2, 8), (5, 5), (2, 3, 5)}


PAGE = """<html><head><title>T</title><style>x{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav><div class="sidebar">Side</div>
<article><h1>Head &amp; tail %d</h1><p>Own  words\n%d <b>bold</b><p>Second &eacute; %d<script>var a</script><div class="advert">Buy</div><p>Follow us on the net</article>
<div id="comments"><p>Nice</p></div><div><p>Recurring line of the site</p></div><footer>Foot</footer>"""


def test_main_text_is_left_alone(spark):
    rows = [(i, f"http://h.example/{i}", PAGE % (i, i, i)) for i in range(30)] + [(30, None, None), (31, "odd", ""), (32, "http://other.example/", "<p>Only &lt;tag&gt;<br>here<p>cut <b"), (33, "http://h.example/x", "a" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert len(got) == 34
    for i in range(30):
        assert got[i] == f"Head & tail {i}\n\nOwn words {i} bold\n\nSecond é {i}"
    assert (got[30], got[31], got[32], len(got[33])) == ("", "", "Only <tag> here\n\ncut", 200_000)
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_text_beside_article_cards_and_section_templates(spark):
    story = lambda i: f"<p>The story number {i} is told here at some length, in words of its own.<p>It goes on for a second paragraph {i}."
    told = lambda i: f"The story number {i} is told here at some length, in words of its own.\n\nIt goes on for a second paragraph {i}."
    rows = [
        (0, "http://a.example/", f"<main>{story(0)}</main><div><article>Card one</article><article>Card two</article></div>"),
        (1, "http://a.example/", f"<main>{story(1)}</main><p>x</p><main>{story(2)}</main>"),
        (2, "http://a.example/", f"<div id=content>{story(3)}</div><article>Card</article>"),
        (3, "http://a.example/", f"<article>{story(4)}</article><div>Short line</div>"),
    ]
    section = "<div><p>All about the gardens of this section and its many readers</p></div>"
    rows += [(100 + i, "http://hot.example/", f"<div>{story(i)}</div>{section if i % 5 < 2 else ''}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert (got[0], got[1], got[3]) == (told(0), told(1) + "\n\n" + told(2), told(4)) and got[2].startswith(told(3))
    assert all(got[100 + i] == told(i) for i in range(300))


def test_names_and_depth_of_elements():
    told = lambda html: html_text.extract(html, frozenset())
    assert told('<article class="post category-social"><p>kept') == told('<article class="has-sidebar"><p>kept') == "kept"
    page = '<article><p>a</p><section class="share-price"><p>b</p></section><div class="sidebar-left">no</div><ol class="comment-list"><li>no</ol><div class="ad-300x250">no</div><div id="siteFooter">no</div></article>'
    assert told(page) == "a\n\nb"
    assert told('<form><div class="sidebar"><article><p>kept</article></div></form><div class="sidebar"><article>card</article></div>') == "kept"
    assert told("<div>" * 100_000 + "x") == told("<div><p>" * 50_000 + "x") == told("<p><b>" * 50_000 + "x</i>") == "x"
    assert len(html_text.hashes("<ul><li>" * 50_000 + "x")) == 100_000
    long = "<p>ten chars!</p>" * 100_000
    assert told(long) == "\n\n".join(["ten chars!"] * 100_000)


def test_forms_minor_articles_and_named_paragraphs_keep_their_prose():
    told = lambda html: html_text.extract(html, frozenset())
    prose = "This is the story of the page, told at some length and in sentences of its own, as a reader would want it. " * 3
    search = "<input type=hidden name=state><input name=q><button>Search</button>"
    assert told(f"<body><form>{search}<div><h1>Title</h1><p>{prose}</p></div></form>") == f"Title\n\n{prose.strip()}"
    assert told(f"<form><div><p>{prose[:100]}</p></div><input name=q></form>") == prose[:100].strip()
    login = "<form><p>Please log in to read on</p><label>Name<input></label><label>Word<input type=password></label><button>Log in</button></form>"
    assert told(f"<div><p>{prose}</p>{login}</div>") == prose.strip() and told(login) == ""
    assert told(f"<article>{prose}</article><article class=search>A story about search</article>") == f"{prose.strip()}\n\nA story about search"
    assert told("<main><p>One.</p><p class=social>He was social.</p><p class=advert>Buy!</p><div class=social>Follow us</div></main>") == "One.\n\nHe was social."
    comments = "<ol><li><article class='comment-body'><p>I liked it</p></article></li></ol>"
    assert told(f"<article>{prose}</article>{comments}") == prose.strip()
    assert told(f"<div><p>{prose}</p><div class='advertisement-top-wide'>Buy</div><div role=dialog>Wait!</div></div>") == prose.strip()
    assert told(f"<div class='has-advertisement'><p>{prose}</p></div>") == prose.strip()
    # a title and a lead right before an article, and all that a main element holds beside it
    assert told(f"<div><div>Menu of the day</div><h1>Title</h1><p>The lead.</p><article>{prose}</article><div>After</div></div>") == f"Title\n\nThe lead.\n\n{prose.strip()}"
    assert told(f"<main><h1>Title</h1><p>The lead.</p><article>{prose}</article><p>A note.</p></main><div>After</div>") == f"Title\n\nThe lead.\n\n{prose.strip()}\n\nA note."


def test_templates_are_those_of_a_plain_count(spark):
    """A slow counter on nested trees: for each host, on how many pages does an element of the same tags and text occur?"""
    rng = random.Random(2)
    parts = ["<p>Welcome to our site, dear reader</p>", "<div><p>Terms of use apply</p><ul><li>one</li><li>two</li></ul></div>", "<div>All about gardens of this section and their readers</div>", "<p>ok</p>"]
    rows = []
    for i in range(400):
        host = "big.example" if i < 300 else f"h{i % 4}.example"
        rows.append((i, f"http://{host}/{i}", "".join(p for k, p in enumerate(parts) if rng.random() < (0.9, 0.6, 0.4, 0.3)[k]) + f"<div><p>Own text {i}</p></div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    count, total = defaultdict(Counter), Counter()
    for _, url, html in rows:
        host = url.split("/")[2]
        total[host] += 1
        found = {m for p in parts if p in html for m in {p, *(x for pattern in ("<p>[^<]*</p>", "<ul>.*</ul>", "<li>[^<]*</li>") for x in re.findall(pattern, p))}}
        count[host].update(found)
    want = set()
    for host, c in count.items():
        for html, n in c.items():
            text = re.sub("<[^>]*>", "", html)
            if n >= 10 and (n >= 0.5 * total[host] or len(text) >= 40 and n >= 100 and n >= 0.02 * total[host]):
                want.add((host, html_text.parse(html)[1].digest, False))
    got = {(r.host, s["subtree"], s["in_article"]) for r in html_text.templates(pages).collect() for s in r.subtrees}
    assert got == want and len(want) > 5
    for r in html_text.main_text(pages).collect():
        if all((r.url.split("/")[2], html_text.parse(p)[1].digest, False) in want for p in parts if p in rows[r.page_id][2]):
            assert r.text == f"Own text {r.page_id}"


def test_salted_templates_equal_broadcast_ones(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    plain = {(r.page_id, r.text) for r in html_text.main_text(pages).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", -1)
    assert {(r.page_id, r.text) for r in html_text.main_text(pages).collect()} == plain


def test_store_compacts_and_keeps_all(spark, docs, empty):
    store = shards.Store(spark, scratch.new_path(spark, "store"), target=200_000, smallest=2_000, fanout=2)
    shards.arrive(docs, store, 6)
    sort = lambda df: sorted(map(str, df.collect()))
    assert sort(store.read()) == sort(docs)
    m = store.manifest()
    assert not store.due(m) and max(r.level for r in m.runs) >= 1
    before = m.version
    store.append(empty)
    assert store.manifest().version == before + 1 and store.read().count() == docs.count()
    with pytest.raises(ValueError, match="columns"):
        store.append(spark.range(3))
    clashing = docs.withColumn("_part", F.lit("mine")).withColumn("_PART_", F.lit(1))
    named = shards.Store(spark, scratch.new_path(spark, "store"))
    shards.arrive(clashing, named, 3)
    assert sort(named.read()) == sort(clashing)
    nothing = shards.Store(spark, scratch.new_path(spark, "store"))
    shards.arrive(empty, nothing)
    assert nothing.read().columns == empty.columns and nothing.read().count() == 0
    # two writers: the one whose inputs are gone gives up, and nothing is lost
    other = shards.Store(spark, store.path, target=200_000, smallest=10**9, fanout=2)
    store.append(docs.limit(1))
    other.compact()
    assert len(other.manifest().runs) == 1 and store.read().count() == docs.count() + 1
    store.vacuum()
    assert store.read().count() == docs.count() + 1
    with pytest.raises(ValueError, match="schema"):
        shards.Store(spark, scratch.new_path(spark, "store")).read()


def test_vacuum_leaves_what_other_writers_are_about_to_commit(spark, docs):
    """One writer has written a run and not committed it; the other appends, merges and sweeps; then the first commits."""
    a, b = (shards.Store(spark, path, target=200_000, smallest=2_000, fanout=2) for path in [scratch.new_path(spark, "store")] * 2)
    b.append(docs)
    run = b._write(docs, 0)
    shards.arrive(docs, a, 4)
    b._add(run, docs.schema.json())
    assert b.read().count() == a.read().count() == 3 * docs.count()
    b.compact()
    a.vacuum()
    assert a.read().count() == 3 * docs.count() and len(a._list("manifests")) == 1
    # what a writer left behind goes once it is old
    left = a._write(docs.limit(1), 0).name
    a.vacuum()
    there = lambda: {s.getPath().getName() for s in a._list("data")}
    assert left in there()
    a.vacuum(grace=-60)
    assert there() == {r.name for r in a.manifest().runs} and a.read().count() == 3 * docs.count()


def test_a_merge_of_runs_that_go_meanwhile_gives_up(spark, docs, monkeypatch):
    a, b = (shards.Store(spark, path, target=200_000, smallest=10**9, fanout=2) for path in [scratch.new_path(spark, "store")] * 2)
    a.append(docs)
    a.append(docs)
    first = []

    def forestalled(m, runs, read=a._frame):
        frame = read(m, runs)
        if not first:
            first.append(b.compact())
            b.vacuum()
        return frame

    monkeypatch.setattr(a, "_frame", forestalled)
    a.compact()
    assert first and len(a.manifest().runs) == 1 and a.read().count() == 2 * docs.count()


def test_one_doc_id_is_no_single_task(spark):
    rows = spark.range(4000).selectExpr("cast(7 as long) doc_id", "concat('text number ', id) text", "id other")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = seekable.write(rows, scratch.new_path(spark, "one")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1 and sum(r.documents for r in files) == 4000 and max(r.documents for r in files) < 3000


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("keys", [1_000_000, -1])
def test_exact_copies(spark, docs, empty, monkeypatch, keys):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[normal(r.text)].append(r.doc_id)
    want = Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, least, len(ids), i == least, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exact_dedup.find(docs, {"text_sha256": exact_dedup.text_sha256(F.col("text"))}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(map(tuple, got.collect())) == want
    left = exact_dedup.drop(docs)
    assert left.columns == docs.columns and Counter(normal(r.text) for r in left.collect()) == Counter(groups.keys())
    assert exact_dedup.find(empty).count() == 0 and exact_dedup.drop(empty).count() == 0


def test_language_of_held_out_documents(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[12].lang_pred == "und" and got[0].score == 0 and got[3].lang_pred != "und"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    kept = language_id.keep(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 1, 12)").count() == 0
    assert language_id.identify(empty).count() == 0 and language_id.keep(empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_automaton_accepts_exactly_the_substrings():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 60)
    table = language_id.automaton(text, 3)
    subs = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(500):
        q = tuple(rng.integers(0, 3, rng.integers(1, 8)))
        s = 0
        for c in q:
            s = table[s, c] if s >= 0 else -1
        assert (s >= 0) == (q in subs)


def test_rare_scripts_beside_a_large_one_are_told_apart():
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    han, georgian, armenian = ([chr(c) for c in range(a, b)] for a, b in ((0x4E00, 0x4E00 + 600), (0x10D0, 0x10F1), (0x561, 0x587)))
    m = language_id.Model({"zh": [text(han, 8000)], "hy": [text(armenian, 100)], "ka": [text(georgian, 100)]})
    asked = [(k, text(letters, 20)) for _ in range(20) for k, letters in (("zh", han), ("ka", georgian), ("hy", armenian))]
    pred, _ = m.predict([t for _, t in asked])
    assert pred == [k for k, _ in asked]
    # letters that nobody sampled are no language's
    n, lost, parsed = m.phrases(["\u03b1\u03b2\u03b3\u03b1"])
    assert parsed[0] == 4 and (n == 5).all() and (lost == 4).all()


def test_rare_letters_are_parsed_as_frequent_ones(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) + x for x in ("xyz", "\u03b1")]
    samples = {"a": texts[:1], "b": texts[1:]}
    want = language_id.Model(samples).phrases([*texts[::-1], "hgfe dcba xyzq \u03b1"])
    monkeypatch.setattr(language_id, "DENSE", 3)
    got = language_id.Model(samples).phrases([*texts[::-1], "hgfe dcba xyzq \u03b1"])
    assert all((g == w).all() for g, w in zip(got, want, strict=True))


def test_phrases_are_those_of_a_plain_parser():
    """Longest matches by substring search in the labelled text; blocks end phrases at the same places."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    samples = {"x": [said(80), said(60)], "y": [said(100)]}
    model = language_id.Model(samples)
    asked = [said(300), "zz " + said(5), "a", "Éa, bé! 3 cd", said(2)]
    n, lost, parsed = model.phrases(asked)
    for j, k in enumerate(model.languages):
        known = " ".join(language_id.fold(" ".join(samples[k])).split()) + " "
        for i, t in enumerate(asked):
            kept = language_id.fold(t)
            kept = re.sub(r"(?<=\S) +", " ", kept).lstrip(" ")
            assert len(kept) == parsed[i]
            count = unknown = 0
            for at in range(0, len(kept), language_id.BLOCK):
                block, own = kept[at : at + language_id.BLOCK], ""
                count += 1
                for c in block:
                    if own + c in known:
                        own += c
                    else:  # the letter begins the next phrase
                        count += 1
                        own = c if c in known else ""
                    unknown += c not in known
            assert (n[i, j], lost[i, j]) == (count, unknown)


def test_languages_that_share_thousands_of_letters_are_told_apart():
    rng = random.Random(9)
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    latin = [["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(300)] for _ in range(4)]
    shared = [["".join(rng.choice(han) for _ in range(2)) for _ in range(2000)] for _ in range(2)]
    said = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    vocabulary = {f"l{i}": w for i, w in enumerate([*latin, *shared])}
    model = language_id.Model({k: [said(w, 270) for _ in range(48)] for k, w in vocabulary.items()})
    for k, w in vocabulary.items():
        pred, _ = model.predict([said(w, 60) for _ in range(50)])
        assert sum(p == k for p in pred) >= 49


def slow_fingerprint(text, words=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_keys_of_fingerprints_are_never_broadcast(spark):
    """Their estimate is that of the fingerprints, which have dozens of keys each: by it they would go through the driver."""
    at = scratch.table(spark.range(2000).select(F.xxhash64("id").alias("fp"), F.xxhash64("id").alias("at")), "at")
    plan = simhash.near_pairs(at)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def brute_components(fps):
    ids = sorted(set(fps))
    parent = {f: f for f in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {f: find(f) for f in ids}


def test_fingerprints_and_components_of_texts(spark, docs, empty):
    rows = docs.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    of = brute_components(fps)
    least = {}
    for r, f in zip(rows, fps, strict=True):
        c = of[f]
        least[c] = r.doc_id if least.get(c) is None else least[c] if r.doc_id is None else min(least[c], r.doc_id)
    want = Counter((r.doc_id, f"{f:016x}", least[of[f]]) for r, f in zip(rows, fps, strict=True))
    got = simhash.cluster(docs).select("doc_id", simhash.as_hex(F.col("fp")), "component_id")
    assert Counter(map(tuple, got.collect())) == want
    left = simhash.drop(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(least.values())
    assert simhash.cluster(empty).count() == 0 and simhash.drop(empty).count() == 0


def test_links_of_close_fingerprints_are_all_found(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))))
    of = brute_components(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in components.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for f in fps:
        mine[got.get(f, f)].add(f)
        theirs[of[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_golay_code_is_perfect():
    errors = simhash.golay_errors()
    assert len(set(errors.tolist())) == 2048
    words = np.random.default_rng(1).integers(0, 1 << 23, 2000)
    at = simhash.index_of(words)
    code = (at << 11) ^ simhash._remainder(at << 11)
    assert all((int(c) ^ int(w)).bit_count() <= 3 for c, w in zip(code, words, strict=True))


def test_nearest_has_high_recall_and_exact_scores(spark):
    real = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = nearest.nearest(real, real.where("vec_id % 20 = 0")).toPandas()
    pdf = real.toPandas()
    v, ids = np.stack(pdf.embedding.to_numpy()).astype(float), pdf.vec_id.to_numpy()
    hits = total = 0
    for q, part in got.groupby("query_id"):
        score = (v * v[ids == q]).sum(axis=1)
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
        assert np.allclose(part.score, [score[ids == i][0] for i in part.vec_id], rtol=1e-12)
        hits += len(best & set(part.vec_id))
        total += 20
    assert len(set(got.query_id)) == (ids % 20 == 0).sum() and hits / total >= 0.9


def test_nearest_leaves_out_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.5]), (20, [float("inf"), 0.0]), (40, [0.5, 0.5]), (1, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash"))
    got = [tuple(r) for r in nearest.nearest(vectors, vectors.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 40, 0.5), (0, 4, 7, -1.0), (40, 1, 0, 0.5), (40, 2, 1, 0.5), (40, 3, 2, 0.5), (40, 4, 7, -0.25)]
    assert nearest.nearest(vectors.limit(0), vectors).count() == 0


def test_nearest_fills_every_query_from_tight_outliers_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    wide = rng.normal(size=(4000, 8))
    v = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    for i in range(6):  # groups of ten, far from the rest and from each other
        v[10 * i : 10 * i + 10] = 5 * np.eye(8)[i] + 1e-7 * rng.normal(size=(10, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, (5 * np.eye(8)[7]).tolist())] * 300
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [*range(0, 60, 3), *range(100, 4000, 200), 5000]
    got = nearest.nearest(vectors, vectors.where(F.col("vec_id").isin(asked))).toPandas()
    at = dict(rows)
    ids, all_ = np.array(sorted(at)), np.array([at[i] for i in sorted(at)])
    assert set(got.query_id) == set(asked)
    hits = 0
    for q, part in got.groupby("query_id"):
        assert sorted(part["rank"]) == list(range(1, 21)) and part.vec_id.nunique() == 20
        score = np.where(ids == q, -np.inf, all_ @ np.array(at[q]))
        hits += len(set(part.vec_id) & set(ids[np.lexsort((ids, -score))[:20]]))
    assert hits / (20 * len(asked)) >= 0.9


def test_pruning_reads_few_lists_of_clustered_vectors(spark):
    """Recall of all queries against brute force, and the share of postings that they are held against."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 12_000)] + 0.35 * rng.normal(size=(12_000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 20 = 0")
    got = nearest.nearest(vectors, queries).toPandas()
    score = x[::20] @ x.T
    score[np.arange(600), 20 * np.arange(600)] = -9
    best = np.argsort(-score, axis=1)[:, :20]
    found = got.groupby("query_id").vec_id.apply(set)
    assert len(got) == 12_000 and np.mean([len(found[20 * i] & set(b)) / 20 for i, b in enumerate(best)]) >= 0.95
    base = nearest.usable(vectors)
    index = nearest.fit(base, 24)
    postings = nearest.assigned(base, index, nearest.CLOSURE, nearest.COPIES, "vec_id").toPandas()
    size = postings.groupby("list").size()
    owned = postings[postings.own].groupby("list").size().reindex(range(len(index.centroids)), fill_value=0).to_numpy()
    probes = nearest.assigned(nearest.usable(queries), index, nearest.REACH, nearest.LISTS, "query_id", owned, nearest.SPARE * 21).toPandas()
    read = probes.groupby("query_id").size()
    assert len(index.centroids) >= 60 and read.mean() < 0.8 * nearest.LISTS and read.max() <= nearest.LISTS
    assert size.reindex(probes.list, fill_value=0).sum() / 600 < 0.3 * size.sum()


def test_nearest_takes_vectors_of_one_length_and_counts_repeats_once(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(301, x[0].tolist())] * 60 + [(302, (2 * x[0]).tolist()), (302, x[0].tolist()), (303, [1.0, 2.0]), (320, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(vectors, vectors.where("vec_id % 20 = 0 or vec_id = 301")).toPandas()
    assert set(got.query_id) == {*range(0, 300, 20), 301} and (got.groupby("query_id").vec_id.nunique() == 20).all()
    mine = got[got.query_id == 0].sort_values("rank")
    assert mine.vec_id.tolist()[:2] == [302, 301] and mine.score.tolist()[:2] == pytest.approx([2, 1])


def test_url_lists_as_of_the_day(spark):
    day = lambda d: pd.Timestamp(d).date()
    events = [("a", "bad.example", day("2024-01-02"), "add"), ("a", "bad.example", day("2024-01-05"), "remove"), ("a", "bad.example", day("2024-01-08"), "add"), ("b", "Good.example/X", day("2024-01-01"), "add"),
              ("b", "both.example", day("2024-01-03"), "add"), ("b", "both.example", day("2024-01-03"), "remove"), (None, "x", day("2024-01-01"), "add"), ("a", None, day("2024-01-01"), "add")]
    urls = [("http://www.BAD.example:80/p", "2024-01-01", 0), ("http://www.bad.example/p", "2024-01-02", 1), ("http://bad.example", "2024-01-05", 0), ("https://u@bad.example/q", "2024-01-09", 1), ("http://notbad.example/", "2024-01-09", 0),
            ("http://good.example/x/y?z", "2024-02-01", 1), ("http://good.example/xy", "2024-02-01", 0), ("http://both.example/", "2024-01-04", 0), (None, "2024-01-03", 0), ("odd", "2024-01-03", 0), ("http://bad.example/", None, 0)]
    captures = spark.createDataFrame([(i, u, None if d is None else day(d), n) for i, (u, d, n) in enumerate(urls)], "id long, url string, day date, want long")
    ev = spark.createDataFrame(events, "list string, pattern string, day date, action string")
    got = url_lists.evaluate(captures, ev)
    assert got.count() == len(urls) and got.where("matches <> want or blocked <> (want > 0)").count() == 0
    assert url_lists.evaluate(captures, ev.limit(0)).where("blocked").count() == 0 and url_lists.evaluate(captures.limit(0), ev).count() == 0


def test_columns_of_captures_are_kept_whatever_their_names(spark):
    day = pd.Timestamp("2024-01-01").date()
    ev = spark.createDataFrame([("a", "bad.example", day, "add")], "list string, pattern string, day date, action string")
    rows = [("http://bad.example/x", day, "mine", 5, "h", "p", 7, "l", day)] * 40 + [("http://good.example/", day, "mine", 6, "h", "p", 8, "l", None)]
    captures = spark.createDataFrame(rows, "url string, day date, _host string, _salt int, _head string, pattern string, n int, list string, from_day date")
    got = url_lists.evaluate(captures, ev)
    assert got.columns == ["url", "day", "_host", "_salt", "_head", "n", "list", "from_day", "matches", "blocked", "pattern"]
    assert Counter((r._host, r._salt, r.n, r.matches, r.pattern) for r in got.collect()) == {("mine", 5, 7, 1, "bad.example"): 40, ("mine", 6, 8, 0, None): 1}


def test_url_entries_of_any_depth_and_case(spark):
    day = pd.Timestamp("2024-01-01").date()
    ev = spark.createDataFrame([("a", x, day, "add") for x in ("deep.example/a/b/c", "deep.example/a/b/c/d/e", "Case.example/Private", "Case.example/Mixed/Up/Case")], "list string, pattern string, day date, action string")
    want = {"http://deep.example/a/b/c/x?q": 1, "http://deep.example//a/b/c": 1, "http://deep.example/a/b/c/d/e/f/g": 2, "http://deep.example/a/b": 0, "http://deep.example/a/b/cc": 0, "http://www.deep.example/a/b/c": 0,
            "http://case.example/Private/x": 1, "http://CASE.example/private": 1, "http://case.example/Mixed/Up/Case/y": 1, "http://case.example/Mixed/Up": 0, "http://case.example": 0}
    captures = spark.createDataFrame([(u, day) for u in want], "url string, day date")
    rows = url_lists.evaluate(captures, ev).collect()
    assert {r.url: r.matches for r in rows} == want and len(rows) == len(want)
    assert {r.pattern for r in rows if r.matches == 2} == {"deep.example/a/b/c/d/e"}


def test_mix_comes_near_its_targets(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.report(real).join(real.select("doc_id", "source"), "doc_id").toPandas()
    assert (rows.taken <= 2 * rows["size"]).all()
    per = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"), own=("size", "sum"))
    assert (per["size"] == per.own).all() and (abs(per.taken - per.target) <= 0.02 * per.target + 2 * mixing.BLOCK).all()
    again = mixing.report(real.repartition(7)).select("doc_id", "taken").toPandas().set_index("doc_id").taken
    assert again.to_dict() == rows.set_index("doc_id").taken.to_dict()
    out = mixing.report(docs).collect()
    assert len(out) == docs.count() and all(r.taken == 0 for r in out if r.size == 0) and all(r.taken <= 2 * r.size for r in out)
    assert mixing.report(empty).count() == 0 and mixing.apply(empty).count() == 0


def test_mix_as_documents_holds_the_words_told(spark, docs):
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    words = sum(len(re.findall(mixing.WORD, r.text)) for r in out.collect())
    assert words == sum(r.taken for r in mixing.report(docs).collect())
    assert out.where("n_chars <> length(text)").count() == 0


def test_small_sources_meet_their_targets_to_the_word(spark):
    sizes = {"a": [1], "b": [20], "c": [100, 29], "d": [7, 193], "e": [3000, 1, 2000, 17]}
    rows = [(i, " ".join(f"{s}{i}x{k}" for k in range(n)), s) for s, ns in sizes.items() for i, n in enumerate(ns, 10 * ord(s))]
    small = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {s: round(t) for s, t in mixing.targets([(s, sum(ns)) for s, ns in sizes.items()]).items()}
    got = mixing.report(small).join(small, "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.max(F.col("taken") > 2 * F.col("size")).alias("over")).collect()
    assert {r.source: r.n for r in got} == want and not any(r.over for r in got)
    words = defaultdict(Counter)
    for r in mixing.apply(small).collect():
        words[r.source].update(r.text.split())
    assert {s: c.total() for s, c in words.items()} == want
    for s, c in words.items():  # whole passes first: no word is taken two times more often than another
        times = [c[f"{s}{i}x{k}"] for i, n in enumerate(sizes[s], 10 * ord(s)) for k in range(n)]
        assert max(times) - min(times) <= 1
    for size, wanted, block in [(129, 258, 8), (129, 200, 128), (129, 130, 128), (1, 2, 1), (20, 3, 1), (200, 399, 128), (5000, 7001, 128)]:
        n, last = mixing.schedule(3, size, wanted, block, 17)
        blocks = -(-size // block)
        turn = np.arange(n) // blocks
        at = mixing.permuted(np.arange(n) % blocks, np.full(n, blocks), mixing.pass_key(3, turn, 17))
        real = np.minimum(block, size - at * block)
        assert real[:-1].sum() + last == wanted and 0 < last <= real[-1]


def test_shards_grow_with_the_corpus_and_ranges_stay_short(spark, docs, monkeypatch):
    rows = mixing.placed(mixing.numbered(docs))
    whole = {(r.row, r.block, r["pass"], r.at, r.words) for r in mixing.mix(rows, 4)[1].collect()}
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 10)
    monkeypatch.setattr(mixing, "GROUPS", 3)
    monkeypatch.setattr(mixing, "RANGE", 2)
    monkeypatch.setattr(mixing, "TASK_SLOTS", 50)
    cut = mixing.mix(rows, 4)[1].collect()
    # the same words are taken, whatever shard a slot belongs to
    assert {(r.row, r.block, r["pass"], r.at, r.words) for r in cut} == whole
    slots = Counter(s for s, _, _ in {(r.shard, r.source, r.slot) for r in cut})
    assert len(slots) > 20 and max(slots.values()) <= 12


def test_targets_stop_at_twice_the_size():
    got = mixing.targets([("b", 100), ("a", 10), (None, 100)])
    assert got["a"] == 20 and got["b"] + got[None] == pytest.approx(295) and got[None] == pytest.approx(2 * got["b"])
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)])["a"] == 0
    size = np.full(1000, 1000)
    assert sorted(mixing.permuted(np.arange(1000), size, np.full(1000, 5))) == list(range(1000))
    counts = np.array(list(mixing.draw(np.array([50, 0, 7]), [1] * 4)))
    assert counts.sum(axis=0).tolist() == [50, 0, 7] and counts.min() >= 0
    uneven = np.array(list(mixing.draw(np.array([600, 0, 300]), [2, 1])))
    assert uneven.sum(axis=0).tolist() == [600, 0, 300] and uneven.sum(axis=1).tolist() == [600, 300]


def test_token_files_give_every_document_back(spark, docs, empty, tmp_path):
    got = seekable.round_trip(docs).collect()
    want = Counter()
    for r in docs.collect():
        ids = library_ids("word_bpe_49k.json", r.text) + (2).to_bytes(4, "little")
        want[r.doc_id, len(ids) // 4, zlib.crc32(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    many = spark.createDataFrame([(i, "some words " * 50) for i in range(400)], "doc_id long, text string").repartitionByRange(8, "doc_id")
    manifest = seekable.write(many, scratch.new_path(spark, "tokens"))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(seekable, "READ_BYTES", 1)
        back = seekable.read(manifest)
        assert back.rdd.getNumPartitions() == manifest.count() and back.count() == 400
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert seekable.round_trip(empty).count() == 0


def test_reader_takes_only_the_frames_asked_for_and_sees_damage(tmp_path):
    path = tmp_path / "f.zst"
    data = {i: np.arange(i, i + 50, dtype="<u4").tobytes() for i in range(40)}
    with path.open("wb") as f:
        w = seekable.Writer(f, frame_ids=100)
        for i, ids in data.items():
            w.add(i, ids)
        w.close()
    size = path.stat().st_size
    import zstandard

    with path.open("rb") as f:  # any zstd reader gets the ids, since the tables are skippable frames
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(data.values())
    with path.open("rb") as f:
        r = seekable.Reader(f, size)
        read = []
        r.frame = lambda k, frame=r.frame: read.append(k) or frame(k)
        assert r.documents(17) == [data[17]] and read == [8] and r.documents(99) == []
        assert dict(r) == data
    raw = bytearray(path.read_bytes())
    table = size - 9 - 20 * 12
    raw[table + 8] ^= 1  # the first frame's checksum
    path.write_bytes(raw)
    with path.open("rb") as f, pytest.raises(ValueError, match="damaged"):
        seekable.Reader(f, size).documents(0)
