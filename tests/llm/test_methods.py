"""Operators that SQL can't express, against plain versions; and the contracts' columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from amplitract.llm import language_id, minhash_dedup, mixing, repeated_passages, site_style_tree, transport_stream
from amplitract.llm.queries import QUERIES, oracles

SF = "/root/testdata/sf0.001"


def near_copies(rng, base, n, most):
    for _ in range(n):
        copy = list(base)
        for k in range(len(copy)):
            if rng.random() < rng.random() * most:
                copy[k] = f"new{rng.randrange(10**9)}"
        yield copy


def test_strays_of_a_leader_keep_their_links(spark):
    """Groups whose pairs lie around the threshold, chains within them, and variants that only each other are near to."""
    rng = random.Random(3)
    texts = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(80)]
        texts += near_copies(rng, base, 40, 0.1)
        variant = base[:]
        variant[5:17] = [f"g{g}v{k}" for k in range(12)]  # too far from the base, near to its own copies
        texts += near_copies(rng, variant, 15, 0.04)
        for k in range(5):  # a chain that leads away from the base
            texts.append([f"g{g}c{i}" if i < 6 * k else w for i, w in enumerate(base)])
    rng.shuffle(texts)
    sets = [frozenset(zip(t, t[1:], strict=False)) for t in texts]
    group = list(range(len(texts)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((top(i), top(j)))
            group[b] = a
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df, words=2).collect()}
    assert found == {k: top(k) for k in range(len(texts))}
    sizes = collections.Counter(found.values())
    assert len(sizes) > 20 and max(sizes.values()) > 20


@pytest.mark.parametrize("every", [False, True])
def test_passages_of_near_copies(spark, every):
    rng = random.Random(17)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(40)}"
    base = [word() for _ in range(150)]
    texts = list(near_copies(rng, base, 30, 0.07)) + [base[20:75] + [word() for _ in range(30)] + base[90:145] for _ in range(3)]
    texts += [[word() for _ in range(40)] + base[60:112] + [word() for _ in range(40)] for _ in range(12)] + [base[:60] + base[10:70], ["x"] * 130, ["x"] * 49, []]
    ids = [k if k % 5 else k // 2 for k in range(len(texts))]  # some share theirs
    held = collections.defaultdict(list)
    rows = list(dict.fromkeys((i, tuple(t)) for i, t in zip(ids, texts, strict=True)))
    for i, t in zip(ids, texts, strict=True):
        for s in range(len(t) - 49):
            held[tuple(t[s : s + 50])].append(i)
    want = set()
    for i, t in rows:
        starts = [s for s in range(len(t) - 49) if (len(held[tuple(t[s : s + 50])]) > 1 if every else len(set(held[tuple(t[s : s + 50])])) > 1)]
        spans = []
        for s in starts:
            if spans and s < spans[-1][1]:
                spans[-1][1] = s + 50
            else:
                spans.append([s, s + 50])
        want |= {(i, *s) for s in spans}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string").repartition(3)
    if not every:  # rows that share an id are one document there: keep one of each
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in {i: t for i, t in rows}.items()], "doc_id long, text string")
        alone = {i: list(t) for i, t in rows}
        held = collections.defaultdict(set)
        for i, t in alone.items():
            for s in range(len(t) - 49):
                held[tuple(t[s : s + 50])].add(i)
        want = set()
        for i, t in alone.items():
            spans = []
            for s in [s for s in range(len(t) - 49) if len(held[tuple(t[s : s + 50])]) > 1]:
                if spans and s < spans[-1][1]:
                    spans[-1][1] = s + 50
                else:
                    spans.append([s, s + 50])
            want |= {(i, *s) for s in spans}
    found = repeated_passages.repeated_passages(df, every=every).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in found} == want and len(want) > 20


def test_permutations(spark):
    rows = [(no, n) for no, n in enumerate((1, 2, 3, 7, 62, 63, 100, 331, 1000))]
    src = spark.createDataFrame(rows, "no long, n_blocks long").withColumn("keys", mixing.round_keys("n_blocks", "no", 2, 1))
    got = src.select("no", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("n_blocks") - 1)).alias("slot"), "keys").withColumn("block", mixing.permuted("slot", "n_blocks", "no")).collect()
    for no, n in rows:
        for use in (0, 1):
            mine = [r.block for r in sorted((r for r in got if r.no == no and r.slot // n == use), key=lambda r: r.slot)]
            assert sorted(mine) == list(range(n))
            if n >= 62:  # neither the order itself nor one fixed step
                steps = collections.Counter((b - a) % n for a, b in zip(mine, mine[1:], strict=False))
                assert max(steps.values()) < n / 4
    big = spark.sql("SELECT 3L AS no, 1000000000000L AS n_blocks").withColumn("keys", mixing.round_keys("n_blocks", "no", 2, 1))
    slots = big.select("*", F.explode(F.array(*[F.lit(k) for k in (0, 1, 10**12 - 1, 10**12, 2 * 10**12 - 1)])).alias("slot")).withColumn("block", mixing.permuted("slot", "n_blocks", "no")).collect()
    assert all(0 <= r.block < 10**12 for r in slots) and len({r.block for r in slots[:3]}) == 3


def test_draw_and_ids_of_any_kind(spark):
    rng = random.Random(5)
    sizes = [(f"doc-{k}", rng.choice(["a", "b", "b", "b", None]), rng.randint(0, 900)) for k in range(300)]
    sized = spark.createDataFrame([(k, *r) for k, r in enumerate(sizes)], "rid long, doc_id string, source string, size long")
    plans = [{r.rid: (r.taken, r.n_shards, r.target) for r in mixing.plan_mix(sized, block_words=16, seed=seed).collect()} for seed in (1, 2)]
    assert len(plans[0]) == 300 and plans[0] != plans[1]
    for plan in plans:
        for source in ("a", "b", None):
            mine = [plan[k] for k, r in enumerate(sizes) if r[1] == source]
            assert abs(sum(t for t, _, _ in mine) - mine[0][2]) <= 32
        assert all(t <= 2 * r[2] and (s > 0) == (t > 0) for (t, s, _), r in zip((plan[k] for k in range(300)), sizes, strict=True))
    src = mixing.source_targets(sized, block_words=16)
    slots = mixing.draw_slots(src, slots_per_shard=500)
    counts = mixing.shard_counts(slots).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    assert len(counts) > 5 and all(300 < r.n < 700 for r in counts) and sum(r.n for r in counts) == src.agg(F.sum("n_slots")).first()[0]
    assert slots.groupBy("no", "block").count().where("count > 2").count() == 0
    docs = spark.createDataFrame([(f"x{k}", "w " * 50, "s") for k in range(20)] + [(None, None, None)], "doc_id string, text string, source string")
    assert mixing.mix_documents(docs).count() >= 20
    huge = spark.createDataFrame([(2**62 + k, "w " * 50, "s") for k in range(20)], "doc_id long, text string, source string")
    assert mixing.mix_documents(huge).count() >= 20


def test_cross_entropy_against_plain_recursion(spark):
    rng = random.Random(1)
    counts = {}
    for lang, letters in (("one", "abcd"), ("two", "bcde")):
        text = "   " + "".join(rng.choice(letters + " ") for _ in range(600))
        counts[lang] = dict(collections.Counter(text[i : i + 4] for i in range(len(text) - 3)))
    model = language_id.compile_model(counts)
    texts = ["abc dea", "bcd", "zzz abcd", "e", "aaaa bbbb cccc dddd " * 20]
    found, sizes = language_id.entropies(model, texts)
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1

    def plain(lang):
        tables = {4: counts[lang]}
        for n in (3, 2, 1):
            tables[n] = collections.Counter(g[1:] for g in tables[n + 1])
        discount, total, kinds = {}, {}, {}
        for n, t in tables.items():
            once, twice = sum(v == 1 for v in t.values()), sum(v == 2 for v in t.values())
            discount[n] = min(max(once / (once + 2 * twice) if once else 0.5, 0.1), 0.95)
            total[n], kinds[n] = collections.Counter(), collections.Counter()
            for g, v in t.items():
                total[n][g[:-1]] += v
                kinds[n][g[:-1]] += 1

        def p(g):
            n, h = len(g), g[:-1]
            if n == 1:
                return (tables[1][g] - discount[1]) / total[1][""] if g in tables[1] else max(discount[1] * kinds[1][""] / total[1][""], 1e-6) / alphabet
            if h not in total[n]:
                return p(g[1:])
            seen = max(tables[n][g] - discount[n], 0) if g in tables[n] else 0
            return seen / total[n][h] + discount[n] * kinds[n][h] / total[n][h] * p(g[1:])

        return p

    for j, lang in enumerate(model.languages):
        p = plain(lang)
        for i, text in enumerate(texts):
            codes = "  " + "".join(map(chr, language_id.normalised(text)))
            logs = [-math.log(p(codes[k : k + 4])) for k in range(len(codes) - 3)]
            assert sizes[i] == len(logs) and abs(found[i, j] - sum(logs) / len(logs)) < 1e-4


def test_training_sample_is_bounded_and_counts_rows_once(spark):
    rows = [(k % 50, f"text {k % 50} " * 10, f"l{k % 90}") for k in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language_id.training_sample(df, max_docs=3, max_chars=250).collect()
    by = collections.defaultdict(list)
    for r in sample:
        by[r.lang].append(r)
    assert len(by) == 90  # no language is left out
    assert all(1 <= len(x) <= 3 and len({r.h for r in x}) == len(x) and sum(len(r.text) for r in x[:-1]) < 250 for x in by.values())


@pytest.mark.parametrize("tag", ["div class='content with-sidebar'", "div id='page' class='no-sidebar'", "div class='wrap header-fixed'", "main class='search-page'", "article class='social-science'"])
def test_names_that_only_hold_a_word_of_the_list(tag):
    html = f"<body><{tag}><p>yes</p><div class='note side-effects'><p>too</p></div><div class='sidebar'>no</div></{tag.split()[0]}>"
    assert site_style_tree.main_blocks(site_style_tree.parse(html), frozenset()) == ["yes", "too"]


def test_silent_elements_end_and_nesting_is_linear():
    import tracemalloc

    text = lambda html: site_style_tree.main_blocks(site_style_tree.parse(html), frozenset())
    assert text("<body><article><p>a</p><div><textarea>no</div><p>b</p><div><svg><path>no</div><p>c</p></article><div>no</div>") == ["a", "b", "c"]
    assert text("<body><article><p>a</p><noscript><div>no</div></noscript><p>b</p><template><div>no</div></template><p>c</article>") == ["a", "b", "c"]
    tracemalloc.start()
    root = site_style_tree.parse("<div class=row>" * 16_000 + "deep")
    site_style_tree.page_features(root)
    assert tracemalloc.get_traced_memory()[1] < 50e6 and site_style_tree.main_blocks(root, frozenset()) == ["deep"]
    tracemalloc.stop()


def test_importance_against_plain_version(spark):
    rng = random.Random(8)

    def page(k):
        parts = [f"<div class=a>{rng.choice(['Menu', 'Home'])}</div>"] if rng.random() < 0.8 else []
        parts += [f"<div class=b><p>{'Text ' + str(k) if rng.random() < 0.7 else 'Same'}</p>{'<ul></ul>' * rng.randint(0, 1)}</div>" for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        return f"<body>{''.join(parts)}</body>"

    pages = [page(k) for k in range(60)]
    df = spark.createDataFrame([(f"http://h.example/{k}", p) for k, p in enumerate(pages)], "url string, html string")
    found = site_style_tree.importance(site_style_tree.path_sums(site_style_tree.node_statistics(df)).collect())
    styles, texts, on = (collections.defaultdict(collections.Counter) for _ in range(3))
    for p in pages:
        s, t = site_style_tree.page_features(site_style_tree.parse(p))
        for path, x in s.items():
            styles[path].update(x)
            on[path]["n"] += 1
        for path, x in t.items():
            texts[path].update(x)

    def entropy(values, unit):
        total = sum(values)
        return -sum(v / total * math.log(v / total) for v in values) / unit

    def plain(path):
        unit = math.log(max(2, on[path]["n"]))
        inside = []
        weights = collections.Counter()
        for style, n in styles[path].items():
            for step in filter(None, style.split(" ")):
                weights[f"{path}/{step}"] += n
        inside = [(n, plain(child)) for child, n in weights.items()]
        if texts[path]:
            inside.append((max(1, sum(styles[path].values())), 1 - sum(math.log(n) for n in texts[path].values()) / (len(texts[path]) * unit)))
        inner = sum(n * v for n, v in inside) / sum(n for n, _ in inside) if inside else float(on[path]["n"] < 2)
        keep = 0.9 ** max(1, len(styles[path]))
        return (1 - keep) * entropy(styles[path].values(), unit) + keep * inner

    assert found.keys() == styles.keys()
    assert all(abs(found[path] - plain(path)) < 1e-9 for path in found)


def test_transport_streams_find_sync_again():
    data = transport_stream.pad(random.Random(4).randbytes(30_000))
    stream = transport_stream.mux(data)
    for at in (188 * 60 + 100, 188 * 90 + 5):
        short = transport_stream.demux(stream[:at] + stream[at + 1 :])[0]
        assert short.packets == transport_stream.demux(stream)[0].packets - 1 and short.lost == 1
    longer = transport_stream.demux(stream[: 188 * 60] + b"xyz" + stream[188 * 60 :])[0]  # the packet before can't be told from a cut one
    assert longer.packets == short.packets and longer.lost == 1


def test_digests_of_stored_streams(spark):
    texts = [None, "", "short", "some words " * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in transport_stream.media_digest(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        media = transport_stream.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        # counted packet by packet
        packets = [media[i : i + 188] for i in range(0, len(media), 188)]
        assert all(p[0] == 0x47 for p in packets)
        pid = lambda p: (p[1] & 31) << 8 | p[2]
        own = [p for p in packets if pid(p) == int(re.search(r"pid=(0x\w+)", r.feature)[1], 16)]
        starts = [p for p in own if p[1] & 0x40]
        access = [k for k, p in enumerate(starts) if p[3] & 0x20 and p[4] and p[5] & 0x40]
        assert f"packets={len(own)} pes={len(starts)} lost=0" in r.feature and f"rap={len(access)}" in r.feature
        assert r.random_access == access and len(r.pts) == len(starts) and r.pts == sorted(r.pts)
        assert f"pts={r.pts[0]}..{r.pts[-1]}" in r.feature
        assert all((b[3] - a[3]) % 16 == 1 for a, b in zip(own, own[1:], strict=False))


#: The columns that must come first, with their types.
CONTRACT = {
    "op1": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op2": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op3": "doc_id:bigint n_bytes:bigint payload_bytes:bigint payload_sha256:string tail_crc32:bigint media_bytes:bigint media_sha256:string feature:string",
    "op7": "doc_id:bigint n_lines:bigint n_dropped:bigint kept_sha256:string",
    "op8": "doc_id:bigint n_shingles:bigint component_id:bigint kept:boolean",
    "op9": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op10": "page_id:bigint url:string text:string n_chars:bigint",
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_keep_their_contracts(spark, name):
    found = QUERIES[name](spark, SF)
    for column in CONTRACT.get(re.match(r"op\d+", name)[0], "").split():
        n, kind = column.split(":")
        assert dict(found.dtypes)[n] == kind
    rows = found.collect()
    source = spark.read.parquet(f"{SF}/{'pages' if 'op10' in name else 'documents'}.parquet")
    if "op6" not in name:
        assert len(rows) == source.count()
    if name in oracles():
        db = duckdb.connect()
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        asked = db.execute(oracles()[name])
        columns = [d[0] for d in asked.description]
        plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
        assert sorted(columns) == sorted(found.columns)
        assert sorted((plain(r[c] for c in columns) for r in rows), key=repr) == sorted(map(plain, asked.fetchall()), key=repr)
