"""Corpus operators against brute force, exact round trips and held-out accuracy, on small fixtures with odd cases."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from amplitract.llm import components, language_id, line_dedup, minhash_dedup, mixing, quality_rules, repeated_passages, sentencepiece_matching, sharding, site_style_tree, transport_stream
from amplitract.llm import words as W

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "one", "a\x0bb\tc", "x " * 3000, "é ß 日本 😀 ▁", "\x00", "same line\nSame Line \n other"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    """Random texts with copies, near copies and shared lines; nulls in every column, repeated rows, a hot source."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeor") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = list(ODD)
    for k in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(5, 160))]
        text = " ".join(body[:40]) + "\n" + ("Shared Line here \n" if k % 4 == 0 else "") + " ".join(body[40:])
        texts += [text, text] if k % 7 == 0 else [text]
        if k % 3 == 0:
            for _ in range(3):
                w = text.split(" ")
                w[rng.randrange(len(w))] = "changed"
                texts.append(" ".join(w))
    rows = [(i, t, rng.choice(["en", "de", None]), "big" if i % 3 else rng.choice(["s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "no id at all but some words", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(docs):
    """Extra columns whose names operators use for their own ends."""
    return docs.select("*", *[F.lit(k).alias(n) for k, n in enumerate(("h", "a", "gone", "slot", "shard", "n", "class", "kept", "score", "ids", "media", "rid", "size", "lines_kept", "n_words"))])


def test_words(rows):
    import pyarrow as pa

    for most in (1, 50, 10_000):
        got = []
        for _, data, offsets in W.pieces(pa.array([r.text for r in rows]), most):
            w = W.Words(data, offsets)
            got += [[bytes(data[w.starts[i] : w.ends[i]]).decode() for i in range(a, b)] for a, b in itertools.pairwise(w.edges)]
        assert got == [split(r.text) for r in rows]


def test_line_dedup(spark, docs, rows):
    strip = lambda x: lower(x).strip(" \t\n\x0b\x0c\r")
    count = collections.Counter(k for r in rows for k in {strip(x) for x in (r.text or "").split("\n")} if k)
    want = []
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if count[strip(x)] < 10]
        want.append((r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    found = line_dedup.mark_lines(clash(docs)).select("doc_id", "n_lines", "n_dropped", "lines_kept").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr) and any(w[2] for w in want)
    assert line_dedup.dedup_lines(clash(docs)).columns == clash(docs).columns
    assert line_dedup.mark_lines(empty(spark)).count() == 0


def test_sharding(spark, docs):
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 0.25 * 1009
    found = sharding.assign_shards(clash(docs), "doc_id", names, 1009).collect()
    for r in found:
        if r.doc_id is not None:
            slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) % 1009
            assert (r.slot, r.shard) == (slot, names[table[slot]])
        assert r.shard in names
    assert len(found) == docs.count() and sharding.assign_shards(empty(spark), "doc_id", names, 1009).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_mixing(spark, docs, rows):
    sized = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", mixing.count_words(F.col("text")).alias("size")).persist()
    found = sized.join(mixing.plan_mix(sized, block_words=16), "rid").collect()
    assert sorted((r.doc_id, r.size) for r in found if r.doc_id is not None) == sorted((r.doc_id, len(split(r.text))) for r in rows if r.doc_id is not None)
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(split(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else share[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over or open_
    for s in order:
        mine = [r for r in found if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 32
    again = sized.join(mixing.plan_mix(sized, block_words=16), "rid").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    mixed = mixing.mix_documents(clash(docs))
    assert mixed.columns == clash(docs).columns and max(r["count"] for r in mixed.where("doc_id <> 20").groupBy("doc_id").count().collect()) <= 2
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_statistics(spark, docs, rows):
    def plainly(t):
        w, lines = split(t), [x for x in (t or "").split("\n") if split(x)]
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = collections.Counter(tri)
        again = {i + j for i, x in enumerate(tri) if count[x] > 1 for j in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)

    many = spark.createDataFrame([(1, " ".join(str(i % 100) for i in range(400)) + " # <>\nx\nx\nx"), (2, "a b c a b c")], "doc_id long, text string")
    for df, texts in ((clash(docs), [r.text for r in rows]), (many, [r.text for r in many.collect()])):
        found = quality_rules.text_statistics(df).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert sorted(map(tuple, found)) == sorted(map(plainly, texts))


def test_rules_separate_planted_classes(spark):
    rng = random.Random(3)
    rows = []
    for k in range(600):
        bad = k % 5 == 0
        symbols = rng.uniform(0.3, 0.9) if bad and k % 2 else rng.uniform(0, 0.1)
        upper = rng.uniform(0.5, 1) if bad and not k % 2 else rng.uniform(0, 0.2)
        rows.append(({f: rng.random() for f in quality_rules.FEATURES} | {"symbols_per_word": symbols, "upper_share": upper}, bad, k))
    rules = quality_rules.learn_rules(rows)
    caught = [any(all(c.holds(r) for c in rule) for rule in rules) for r, _, _ in rows]
    assert sum(c == bad for c, (_, bad, _) in zip(caught, rows, strict=True)) >= 590 and len(rules) <= 12
    assert quality_rules.learn_rules([]) == [] and quality_rules.learn_rules([(r, False, k) for r, _, k in rows]) == []
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    judged = quality_rules.judge(spark.createDataFrame([(1, "w " * 60), (2, None)], "doc_id long, text string"), labels).collect()
    assert {r.doc_id: r.kept for r in judged} == {1: False, 2: False}


def test_quality_on_labelled_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality_rules.judge(docs, labels).join(labels, "doc_id").where("NOT base_failed")
    wrong = found.where((F.col("quality") == 1) != F.col("kept")).count()
    assert wrong <= 0.02 * found.count()


def test_transport_stream(spark, docs, rows):
    rng = random.Random(4)
    for n in (0, 1, 191, 192, 193, 3072, 3073, 20_000):
        data = transport_stream.pad(rng.randbytes(n))
        stream = transport_stream.mux(data)
        back = transport_stream.demux(stream)
        assert [s.payload for s in back] == [data] and back[0].lost == 0 and back[0].pes == len(back[0].stamps) == len(back[0].random_access)
        assert transport_stream.demux(b"junk" + stream)[0].payload == data
    lost = transport_stream.demux(stream[: 188 * 5] + stream[188 * 6 :])[0]
    assert lost.lost == 1 and len(lost.payload) < len(data)
    twice = transport_stream.demux(stream[: 188 * 6] + stream[188 * 5 :])[0]
    assert twice.payload == data and twice.lost == 0
    assert transport_stream.demux(b"") == transport_stream.demux(b"\x47" * 999) == []
    found = transport_stream.media_digest(clash(docs)).collect()
    want = [(r.doc_id, len((r.text or "").encode()), hashlib.sha256(transport_stream.pad((r.text or "").encode())).hexdigest()) for r in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.payload_sha256) for r in found), key=repr) == sorted(want, key=repr)
    read = transport_stream.read_media(transport_stream.store_text(clash(docs))).select("text", F.col("streams")[0]["payload"].alias("p")).collect()
    assert all(bytes(r.p) == transport_stream.pad((r.text or "").encode()) for r in read)


def test_sentencepiece_ids_are_the_librarys(spark, docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_matching.MODEL)
    found = sentencepiece_matching.encode(clash(docs)).select("text", "ids")
    decoded = sentencepiece_matching.decode(found).collect()
    assert len(decoded) == len(rows)
    for r in decoded:
        assert r.ids == (None if r.text is None else lib.encode(r.text))
        assert r.decoded == (None if r.text is None else lib.decode(r.ids))
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab \n▁éx日😀\x00the in") for _ in range(rng.randrange(90))) for _ in range(400)] + ["q" * 500, "ab" * 200 + " " * 50]
    pieces = sentencepiece_matching.Pieces(lib.serialized_model_proto())
    assert [list(x) for x in sentencepiece_matching.encode_batch(texts, pieces)] == [lib.encode(t) for t in texts]
    assert sentencepiece_matching.encode(empty(spark)).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(20):
        codes = rng.integers(0, 4, rng.integers(2, 200)).astype(np.uint32)
        order = sentencepiece_matching.suffix_order(codes, 16)
        keys = [tuple(codes[i : i + 16]) for i in order]
        assert sorted(order) == list(range(len(codes))) and keys == sorted(keys)


def test_language_id(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language_id.train(docs, learn=~held, max_docs=150)
    found = language_id.identify(docs.where(held), model).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.98 * len(found) and sum(r.rejected for r in found) <= 0.01 * len(found)
    odd = language_id.identify(spark.createDataFrame([(t,) for t in (None, "", "123 %%% \n", "漢字かな交じり文の長い文章です。" * 20)], "text string"), model).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(r.rejected for r in odd) and all(0 <= r.score <= 1 for r in odd)
    # each context's probabilities, seen and unseen, sum to one over the alphabet and one unseen character for each mass
    nothing = language_id.train(empty(spark))
    assert language_id.identify(docs.limit(3), nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def test_kneser_ney_sums_to_one():
    text = "  the cat and the other cat then ate that "
    counts = collections.Counter(text[i : i + 4] for i in range(len(text) - 3))
    seen, weight, left = language_id._kneser_ney(dict(counts), 4)
    letters = set(text)
    p = lambda g: np.exp(seen[len(g)][g]) if g in seen[len(g)] else (np.exp(weight.get(g[:-1], 0.0)) * p(g[1:]) if len(g) > 1 else 0.0)
    assert abs(sum(p(c) for c in letters) + left - 1) < 1e-9
    for context in ("the", " ca", "zzz"):
        missing = left * np.prod([np.exp(weight.get(context[k:], 0.0)) for k in range(3)])
        assert abs(sum(p(context + c) for c in letters) + missing - 1) < 1e-6


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)]
    parent = {n: n for e in links for n in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    found = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {n: top(n) for n in parent if top(n) != n}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, docs, rows, words):
    sets = []
    for r in rows:
        w = split(lower(r.text))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    at = {}
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            group[b] = a
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            at[top(i)] = min(at.get(top(i), r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, len(sets[i]), at.get(top(i))) for i, r in enumerate(rows)), key=repr)
    found = minhash_dedup.near_duplicates(clash(docs), words=words).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found if r.component_id is not None)
    kept = minhash_dedup.dedup_documents(clash(docs), words=words)
    assert kept.columns == clash(docs).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.kept}
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    for size in (3, 40, 900):
        a = rng.integers(0, 2**63, size).astype(np.uint64)
        b = np.concatenate([a[: size * 2 // 3], rng.integers(0, 2**63, size // 3).astype(np.uint64)])
        real = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        same = np.mean([np.mean(minhash_dedup.sketch(W.mix64(a + np.uint64(k)), 312) == minhash_dedup.sketch(W.mix64(b + np.uint64(k)), 312)) for k in range(10)])
        assert abs(same - real) < 0.06


def test_repeated_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 120)]
    texts = []
    for k in range(40):
        body = [word() for _ in range(rng.randint(0, 200))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = p
        texts.append(" ".join(body))
    texts += [None, "", texts[3], "a " * 300, "a " * 200, " ".join([*passages[3], "x", *passages[3]])]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    held = collections.defaultdict(set)
    w = [split(lower(t)) for t in texts]
    for k, x in enumerate(w):
        for i in range(len(x) - 49):
            held[tuple(x[i : i + 50])].add(k)
    want = set()
    for k, x in enumerate(w):
        starts = [i for i in range(len(x) - 49) if len(held[tuple(x[i : i + 50])]) > 1]
        for i in starts:
            if i == starts[0] or i - last >= 50:
                first = i
            last = i
            want = {s for s in want if (s[0], s[1]) != (k, first)} | {(k, first, i + 50)}
    found = repeated_passages.repeated_passages(docs.withColumn("prefix", F.lit(1))).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in found} == want and len(found) == len(want)
    assert all(r.other != r.doc_id for r in found)
    assert repeated_passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pages(spark):
    page = lambda body, url="http://h.example/1": (url, f"<!DOCTYPE html><html><head><title>t</title><script>var x='</p>';</script></head><body>{body}")
    cases = [
        page("<nav><ul><li>menu</li></ul></nav><article><h1>A &amp; B&nbsp;c</h1><p><b>one<br>two<p>three  \n four</article><footer>end</footer>"),
        page("<article><p>x<aside>no</aside><p>y<form><input value='q'>no</form><section class='comments'><p>no</section><div class='ad-slot'>no</div><p>z"),
        page("<div class='content'><p>plain &lt;b&gt;</p></div><div class='sidebar'>no</div>"),
        (None, None),
        ("not a url", "<<< <p>broken &am <p"),
    ]
    want = ["A & B c\none\ntwo\nthree four", "x\ny\nz", "plain <b>", "", None]
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    found = {r.page_id: r for r in site_style_tree.extract(df).collect()}
    for k, text in enumerate(want):
        assert text is None or found[k].text == text
        assert found[k].n_chars == len(found[k].text)
    # what all pages of a host say outside of an article goes, whatever it is called; what they say in one stays
    rows = [(k, f"http://s.example/{k}", f"<body><div class='alpha'>All the same</div><div class='beta'><p>Own text number {k}</p><p>Said by all</p></div></body>") for k in range(30)]
    rows += [(100 + k, f"http://t.example/{k}", f"<body><article><p>Said by all</p><p>{k}</p></article></body>") for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in site_style_tree.extract(df).collect()}
    assert all(found[k] == f"Own text number {k}\nSaid by all" for k in range(30))
    assert all(found[100 + k] == f"Said by all\n{k}" for k in range(30))
    assert site_style_tree.extract(df.where("page_id < 0")).count() == 0


def test_articles_are_not_pruned_from_outside(spark):
    tree = site_style_tree
    text = lambda html, *low: tree.main_blocks(tree.parse(html), frozenset(low))
    # names on an article, or around it, don't hide it; names in it do
    assert text("<body><form id='aspnetForm'><div class='sidebar-layout'>no<article class='share'><p>yes</p><div class='comments'><article>no</article></div></article></div></form>") == ["yes"]
    assert text("<body><main class='banner'>yes<div class='widget'>no<article>and</article></div></main>") == ["yes", "and"]
    assert text("<body><aside><article>teaser</article>no</aside><div>own</div>") == ["teaser", "own"]
    assert text("<body><nav>no</nav><article>yes</article><div>no</div>", "/body", "/body/article") == ["yes"]

    rows = [(f"http://copies.example/{k}", f"<body><article><p>Article {k % 5}</p></article></body>") for k in range(500)]
    rows += [(f"http://heads.example/{k}", f"<body><article><h2>Summary</h2><p>Text {k}</p></article></body>") for k in range(30)]
    rows += [(f"http://bodies.example/{k}", f"<body>{'<div></div>' if k < 970 else f'<div class=x{chr(97 + (k - 970) % 20)}></div>'}<article><p>{k}</p></article></body>") for k in range(1000)]
    df = spark.createDataFrame(rows, "url string, html string")
    found = {r.url: r.text for r in tree.extract(df).collect()}
    assert all(found[f"http://copies.example/{k}"] == f"Article {k % 5}" for k in range(500))
    assert all(found[f"http://heads.example/{k}"] == f"Summary\nText {k}" for k in range(30))
    assert all(found[f"http://bodies.example/{k}"] == str(k) for k in range(1000))


def test_all_styles_and_rare_templates_count(spark):
    from math import log

    # a wrapper with one style on 70 percent of the pages and a style of its own on each other page
    steps = lambda k: "".join(f"<{'ul' if k >> b & 1 else 'ol'}></{'ul' if k >> b & 1 else 'ol'}><hr><h3></h3>" for b in range(11))
    rows = [(f"http://w.example/{k}", f"<body><div class='wrap'>{steps(k) if k < 600 else ''}<p>Text {k}</p></div></body>") for k in range(2000)]
    # what 30 of 3000 pages say is said by a template of theirs
    rows += [(f"http://b.example/{k}", f"<body>{'<div class=rare>Same on all of these</div>' if k < 30 else ''}<p>Text {k}</p></body>") for k in range(3000)]
    df = spark.createDataFrame(rows, "url string, html string")
    found = {r.url: r.text for r in site_style_tree.extract(df).collect()}
    assert all(found[f"http://w.example/{k}"] == f"Text {k}" for k in range(2000))
    assert all(found[f"http://b.example/{k}"] == f"Text {k}" for k in range(3000))
    sums = site_style_tree.path_sums(site_style_tree.node_statistics(df)).where("host = 'w.example'").collect()
    wrap = next(r for r in sums if r.path == "/body/div.wrap")
    assert (wrap.pages, wrap.n_styles, wrap.total) == (2000, 601, 2000)
    exact = -(0.7 * log(0.7) + 600 * log(1 / 2000) / 2000) / log(2000)
    assert abs(site_style_tree.importance(sums)["/body/div.wrap"] - exact) < 1e-9


def test_near_copies_without_ids_lead_and_bridge(spark):
    rng = random.Random(21)
    # a chain: each text is near to the next only
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    chains = [[[f"{c}new{i}" if i < 8 * k else f"{c}{w}" for i, w in enumerate(base)] for k in range(3)] for c in "abcdefgh"]
    rows = []
    for i, chain in enumerate(chains):  # the bridge has no id
        rows += [(10 * i + 1, " ".join(chain[0])), (None, " ".join(chain[1])), (None, " ".join(chain[1])), (10 * i + 2, " ".join(chain[2]))]
    for g in range(12):  # groups of near copies, many of them without ids, so that some of those lead their buckets
        words = [f"g{g}w{i}" for i in range(200)]
        for k in range(40):
            copy = list(words)
            copy[k * 5] = "changed"
            rows.append((1000 + 100 * g + k if k % 8 == 0 else None, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = minhash_dedup.near_duplicates(df, words=2).collect()
    assert len(found) == len(rows)
    of = collections.defaultdict(set)
    for r in found:
        of[r.doc_id].add(r.component_id)
    assert all(of[10 * i + 1] == of[10 * i + 2] == {10 * i + 1} for i in range(8))
    assert all(of[1000 + 100 * g + k] == {1000 + 100 * g} for g in range(12) for k in range(0, 40, 8))
    assert of[None] == {10 * i + 1 for i in range(8)} | {1000 + 100 * g for g in range(12)}
    assert sorted(r.doc_id for r in minhash_dedup.dedup_documents(df, words=2).collect()) == sorted(of[None])


def test_every_place_of_a_passage_counts(spark):
    rng = random.Random(31)
    text = lambda n: [f"t{rng.randrange(10**9)}" for _ in range(n)]
    twice, hidden, same, both = (text(60) for _ in range(4))
    rows = [
        (1, [*text(10), *twice, *text(30), *twice]),
        (2, [*text(5), *hidden, *text(70)]),
        (None, [*hidden, *text(3)]),
        (3, [*same, *text(8)]),
        (3, [*text(9), *same]),
        (None, [*both, *text(1)]),
        (None, [*text(2), *both]),
        (4, text(100)),
        (5, ["a"] * 80),
        (6, twice[:49]),
    ]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    found = repeated_passages.repeated_passages(df, every=True).collect()
    want = [(1, 10, 70, 1), (1, 100, 160, 1), (2, 5, 65, 2), (None, 0, 60, 2), (3, 0, 60, 3), (3, 9, 69, 3), (None, 0, 60, None), (None, 2, 62, None), (5, 0, 80, 5)]
    assert sorted(((r.doc_id, r.start_word, r.end_word, r.other) for r in found), key=repr) == sorted(want, key=repr)
    equal = repeated_passages.repeated_passages(df.where("doc_id = 4").unionAll(df.where("doc_id = 4")), every=True).collect()
    assert [(r.doc_id, r.start_word, r.end_word) for r in equal] == [(4, 0, 100)]
