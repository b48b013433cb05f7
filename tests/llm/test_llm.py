"""The ten operators and the pipeline against SQL, the libraries and brute force."""

from __future__ import annotations

import math
import re
import sys
import zlib
from collections import Counter as Tally
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import corpus_pipeline
from cinefold.llm import blockmax, components, htmltext, jaccard, mixing, packing, pii, quality, queries, simhash, tokencount, tokens, urlfilter, vptree
from compare import SMALL, connection, same

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()]


def odd_docs(spark):
    """Nulls, empty and repeated rows, white space alone, and columns that clash with those the operators add."""
    rows = [(1, None, "en", None, None), (2, "", "en", "b", 0), (2, "", "en", "b", 0), (None, "one two three", None, "a", 13), (4, " \t\n", "de", "a", 3), (5, "ONE two Three", "en", "a", 13), (6, "x" * 70_000, "en", "c", 70_000), (7, "y z " * 9000, "en", "c", 36_000)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("size", "target", "id", "label", "masked", "n_tokens", "component_id", "sequence_id")})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name], connection())


# 1 ------------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    top = {p: p for p in prints}

    def root(p):
        while top[p] != p:
            p = top[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                top[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in prints}


def test_fingerprints():
    for text in [*TEXTS[:60], "", " ", "É A", "a b c", "a b c d", "a b c d e"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("shard", [3, 4096])
def test_links_equal_brute_force(spark, shard):
    random = np.random.default_rng(1)
    centres = random.integers(0, 2**63, 12, dtype=np.uint64)
    values = {int(c) for c in centres} | {0, 1, 31, 2**64 - 1}
    for c in centres[:6]:
        for _ in range(15):
            v = int(c)
            for b in random.integers(0, 64, random.integers(1, 6)):
                v ^= 1 << int(b)
            values.add(v)
    rows = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp long")
    edges = simhash.star_links(rows, 4, shard)
    found = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    theirs = plain_components(values, 4)
    groups = lambda of: sorted(sorted(g) for g in of.values() if len(g) > 1)
    ours, brute = defaultdict(set), defaultdict(set)
    for v in values:
        signed = v - 2**64 if v >> 63 else v
        ours[found.get(signed, signed)].add(v)
        brute[theirs[v]].add(v)
    assert groups(ours) == groups(brute)


def test_near_duplicates_of_odd_rows(spark):
    found = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(found) == 8
    by = {(r["id"], r["fingerprint"]): r["component_id"] for r in found}
    assert by[1, "0" * 16] == by[2, "0" * 16] == by[4, "0" * 16] == 1
    assert len({r["component_id"] for r in found if r["id"] in (None, 5)}) == 1 and {r["component_id"] for r in found if r["id"] is None} == {5}
    assert sorted(r["doc_id"] for r in simhash.deduplicate(odd_docs(spark)).collect()) == [1, 5, 6, 7]
    assert simhash.near_duplicates(odd_docs(spark).limit(0)).count() == 0


# 2 ------------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    d = SMALL.replace("sf0.001", "sf0.01")
    rows = queries.op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(2, 1), (None, 0), (5, None), (6, 7), (7, 0)], "doc_id long, quality int")
    found = quality.classify(odd_docs(spark), labels).collect()
    assert len(found) == 8 and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in quality.classify(odd_docs(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd_docs(spark).limit(0), labels).count() == 0


def test_quality_equals_a_plain_discriminant(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    known = dict(labels.select("doc_id", "quality").collect())
    rows = [(r["doc_id"], np.array(quality.statistics(r["text"]))) for r in docs.select("doc_id", "text").collect()]
    taught = [(x, known[d]) for d, x in rows if d in known and zlib.crc32(str(d).encode()) % 3 != 1]
    every = np.array([x for x, _ in taught])
    centre, spread = every.mean(axis=0), np.sqrt(np.maximum(every.var(axis=0), 1e-6))
    log = {}
    for c in (0, 1):
        own = (np.array([x for x, q in taught if q == c]) - centre) / spread
        d = own.shape[1]
        cov = 0.8 * np.cov(own.T, bias=True) + 0.2 * np.eye(d) + 1e-3 * np.eye(d)
        gaps = (np.array([x for _, x in rows]) - centre) / spread - own.mean(axis=0)
        log[c] = np.log((len(own) + 0.5) / (len(taught) + 1)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gaps, np.linalg.inv(cov), gaps)
    want = {d: 1 / (1 + np.exp(np.clip(a - b, -700, 700))) for (d, _), a, b in zip(rows, log[0], log[1])}
    found = {r["id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert found.keys() == want.keys() and all(found[d] == pytest.approx(want[d], abs=1e-6) for d in want)


# 3 ------------------------------------------------------------------------------------------------------------------


def test_byte_ids_equal_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", "  a  b", "a  \n b", "x <|endoftext|> y", "\n\n a\tb ", "don't 'tis", "a\xa0\xa0 \n b", "a\x1c b", "日本 語", "İ Σς"]
    own = tokens.ByteEncoder("byte_bpe_50k.json")
    for texts in (odd, TEXTS):
        assert own.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, documents):
    """Pieces lie gapless in sequences, and give back every document's ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Tally()
    for ident, text in documents:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or min(len(ids), 1024)
        edges = [0, *range(head, len(ids), 1024), len(ids)] if len(ids) > head else [0, len(ids)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want[ident, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Tally((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(held), math.ceil(sum(r["length"] for r in rows) / 1024)


@pytest.mark.parametrize("run", [" ", "\n", "\t", " \n", "\u00a0"])
def test_byte_ids_of_long_white_space(run):
    """Runs that the faster library can't hold."""
    encoder = tokens.ByteEncoder("byte_bpe_50k.json")
    text = "begin " + run * (3_000_000 // len(run)) + " end"
    whole = encoder.encode([text, "a short text"])
    library = encoder.library.encode(text, add_special_tokens=False).ids
    assert np.array_equal(np.frombuffer(whole[0], "<u4"), np.array(library, "<u4")) and encoder.quick is not None


def test_packing_round_trip(spark):
    rows = queries.op3_best_fit_packing(spark, SMALL).collect()
    used, least = check_packing(rows, enumerate(TEXTS))
    assert used <= least * 1.05 + 1
    odd = odd_docs(spark)
    check_packing(packing.pack(odd).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(odd.limit(0)).count() == 0


@pytest.mark.parametrize("lengths", [[1024] * 5, [600] * 7, [1] * 3000, list(range(1, 1025)), [513, 511, 512, 512], []])
def test_plans_hold_every_item(lengths):
    found = packing.plan(dict(Tally(lengths)), 1024)
    assert all(sum(x) <= 1024 and n > 0 for x, n in found)
    assert sum((Tally({k: v * n for k, v in Tally(x).items()}) for x, n in found), Tally()) == Tally(lengths)
    assert sum(n for _, n in found) <= max(1.1 * sum(lengths) / 1024 + 1, sum(x > 512 for x in lengths))


def fewest(lengths, capacity):
    """The least number of sequences, by trying every way."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best[0]


def test_configurations_and_plans_against_every_way():
    import random

    r = random.Random(11)
    for _ in range(40):
        counts = Tally(r.choices((97, 64, 55, 48, 41, 33, 26, 20, 15, 9), k=9))
        sizes, needs = zip(*sorted(counts.items(), reverse=True))
        found = packing.configurations(list(sizes), list(needs), 100)
        assert all(t > -1e-9 and sum(n * s for n, s in zip(places, sizes)) <= 100 for places, t in found)
        assert all(sum(places[i] * t for places, t in found) >= needs[i] - 1e-6 for i in range(len(sizes)))
        least, lengths = fewest(sorted(counts.elements(), reverse=True), 100), sum(t for _, t in found)
        assert sum(n * s for n, s in zip(needs, sizes)) / 100 - 1e-6 <= lengths <= least + 1e-6
        planned = packing.plan(dict(counts), 100, groups=4)
        assert least <= sum(n for _, n in planned) <= least + 1
        assert sum((Tally({k: v * n for k, v in Tally(x).items()}) for x, n in planned), Tally()) == counts


# 4, 5 ---------------------------------------------------------------------------------------------------------------


def test_trees():
    random = np.random.default_rng(2)
    points = np.concatenate((random.normal(size=(600, 8)), np.ones((300, 8))))
    tree, ids = vptree.Tree(np.arange(900), points, leaf=16), np.arange(900)
    asked = points[::50]
    true = np.sqrt(((asked[:, None] - np.unique(points, axis=0)[None]) ** 2).sum(axis=2))
    true.sort(axis=1)
    assert np.allclose(tree.search(asked, 10, 1.0)[0], true[:, :10])
    assert (tree.search(asked, 10, 0.5)[0] <= true[:, 9:10] + 1e-9).mean() >= 0.9
    assert set(tree.ids) == set(ids)


def odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (9, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))


def test_vectors_with_ties_and_holes(spark):
    rows = odd_vectors(spark)
    near = vptree.search(vptree.build(rows), rows.where("vec_id % 100 = 0"), k=3, factor=1.0)
    assert sorted(map(tuple, near.collect())) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, math.sqrt(2)), (100, 1, 0, math.sqrt(2)), (100, 2, 1, math.sqrt(2)), (100, 3, 2, math.sqrt(2))]
    top = blockmax.top_k(rows, rows.where("vec_id % 100 = 0"), k=3)
    assert sorted(map(tuple, top.collect())) == [(0, 1, 1, 65536), (0, 2, 2, 65536), (0, 3, 4, 0), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0)]
    assert vptree.search(vptree.build(rows.limit(0)), rows).count() == 0 and blockmax.top_k(rows.limit(0), rows).count() == 0


def test_vectors_with_a_hot_id(spark):
    rows = [(7, [1.0, 0.001 * n]) for n in range(30)] + [(0, [1.0, 0.0002 * n]) for n in range(30)] + [(n, [0.9 - 0.1 * n, 0.0]) for n in range(1, 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.where("vec_id = 0")
    near = vptree.search(vptree.build(table), asked, k=4, factor=1.0)
    assert [r["vec_id"] for r in near.orderBy("rank").collect()] == [7, 1, 2, 3]
    assert [r["vec_id"] for r in blockmax.top_k(table, asked, k=4).orderBy("rank").collect()] == [7, 1, 2, 3]


def test_products_beyond_a_long_are_held_at_its_ends(spark):
    rows = [(0, [1e-20, 0.0]), (1, [1e20, 1.0]), (2, [3e20, 1.0]), (3, [2e20, -1.0]), (50, [2.0**-8, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    top = blockmax.top_k(table, table.where("vec_id = 50"), k=3)
    assert [r["vec_id"] for r in top.orderBy("rank").collect()] == [1, 2, 3] and {r["score"] for r in top.collect()} == {2**63 - 1}
    asked = spark.createDataFrame([(9, [2.0**-8])], "vec_id long, embedding array<float>")
    near = spark.createDataFrame([(n, [2.0**50 * (1 + n / 8)]) for n in range(5)], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in blockmax.top_k(near, asked, k=2).orderBy("rank").collect()] == [(4, 2**58 * 3 // 2), (3, 2**58 * 11 // 8)]


def test_blocks_prune_and_stay_exact():
    random = np.random.default_rng(3)
    rows = np.repeat(random.integers(-40, 40, (20, 6)), 50, axis=0).astype(float) + random.integers(0, 3, (1000, 6))
    index = blockmax.Blocks(np.arange(1000), rows, size=50)
    found, scored = index.search(np.arange(0, 1000, 100), rows[::100], 5)
    for q, best in zip(range(0, 1000, 100), found):
        scores = sorted((-int(s), i) for i, s in enumerate(rows @ rows[q]) if i != q)[:5]
        assert best == scores
    assert scored < 10 * 20 * 0.7
    huge = blockmax.Blocks(np.arange(3), np.array([[2.0**40], [2.0**41], [-(2.0**41)]]), size=1)
    assert huge.search(np.array([9]), np.array([[2.0**40]]), 1)[0] == [[(-(2**81), 1)]]


# 6 ------------------------------------------------------------------------------------------------------------------


def test_mix_comes_near_its_targets(spark):
    rows = mixing.mix(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    assert len(rows) == len(TEXTS)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    assert sum({r["source"]: r["target"] for r in rows}.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))


def test_mix_of_odd_rows(spark):
    found = mixing.mix(odd_docs(spark)).collect()
    assert len(found) == 8 and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    assert {r["size"] for r in found if r["text"] in (None, "", " \t\n")} == {0}
    assert mixing.mix(odd_docs(spark).limit(0)).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["", " ", "<|startoftext|> a<|endoftext|>b", "ÀÉ Àé́ x", "12 345", "don't", "a\x1cb", "日本語 " * 40, "z" * 500]
    for chunk, overlap in ((65_536, 1024), (40, 5)):
        assert tokens.Counter("word_bpe_49k.json", chunk, overlap).count([*odd, *TEXTS]) == [len(library.encode(t, add_special_tokens=False).ids) for t in [*odd, *TEXTS]]
    found = tokencount.count_tokens(odd_docs(spark)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in found)[:3] == [(0, 13, 3), (1, 0, 0), (2, 0, 0)]
    assert {r["over_limit"] for r in found if r["doc_id"] == 7} == {True}
    assert tokens.Counter("piece_bpe_32k.model", 10, 2).count(["", "hello world"])[0] == 0


# 8 ------------------------------------------------------------------------------------------------------------------


def test_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.example.org/es/x", link.format("http://q.net/1")),
        (2, "http://q.net/1", "<meta http-equiv='refresh' content='0; url=/2'>"),
        (3, "HTTP://Q.net/2#top", ""),
        (4, "http://q.net/3", link.format("http://x.com/de/1")),
        (5, "http://x.com/fr/1", link.format("http://q.net/3")),
        (6, "http://example.org/en/1?q", ""),
        (7, "http://notexample.org/es/", ""),
        (8, None, None),
        (9, "no scheme", "<!-- " + link.format("http://q.net/1") + " -->"),
        (10, "x://COM/de/a", ""),
        (11, "x://com", ""),
        (11, "x://com", ""),
    ]
    rows = spark.createDataFrame(pages, "page_id int, url string, html string").withColumn("rule", F.lit(3))
    found = defaultdict(list)
    for r in urlfilter.judge(rows).collect():
        found[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert found[1] == [("a.example.org", "/es/x", "example.org/es/", "block")]
    assert [found[k][0][3] for k in (2, 3, 4, 5)] == ["block", "block", "allow", "allow"]
    assert found[3][0][:3] == ("q.net", "/2", None)
    assert found[6] == [("example.org", "/en/1", "example.org/en/1", "block")] and found[7][0][2:] == ("org/", "allow")
    assert found[8] == [("", "", None, "allow")] and found[9] == [("", "", None, "allow")]
    assert found[10] == [("com", "/de/a", "com/de/", "block")] and found[11] == [("com", "", None, "allow")] * 2
    assert urlfilter.judge(rows.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id INTEGER, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert same(urlfilter.judge(rows).select("page_id", "host", "path", "rule", "verdict"), urlfilter.SQL, con)


def test_components_of_a_path_and_a_star(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(12)] + [("hub", f"z{i}") for i in range(20)] + [("solo", "solo"), (None, "x")]
    for native in (False, True):
        found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a string, b string"), native).collect()}
        assert {found[f"n{i:03}"] for i in range(13)} == {"n000"} and {found[f"z{i}"] for i in range(20)} == {"hub"} and found["solo"] == "solo" and len(found) == 35


# 9 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("<p>hi", "hi"), ("a<b>c</b>d<p>x &amp; y&nbsp;z", "acd x & y z"), ("<script>if(a<b){}</script>t", "t"), ("<!-- x <p>no</p> -->yes", "yes"), ('<p title="a>b">q</p>', "q"),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>One, two.<p>Three.</article><footer>&copy; me.</footer>", "T One, two. Three."),
        ("<div class='main'><p>A text, of some length.</p><p>Short</p></div><div id=comments><p>Reader says, no.</p></div><aside>side</aside>", "A text, of some length. Short"),
        ("<body><div class=cookie-notice>We use cookies.</div><ul><li><a href=1>x</a><li><a href=2>y</a></ul><p>Words, words. More words.</p>", "Words, words. More words."),
        ("<style>p{}</style><form><input value=1>go</form>", ""),
    ],
)
def test_main_text(html, text):
    assert htmltext.main_text(html) == text


def plain_article(html):
    """What stands in a page's article, blocks set apart by one space."""
    inner = re.search("<article>(.*)</article>", html, re.S)[1]
    return " ".join(__import__("html").unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:br|p|h1)>", " ", inner))).split())


def without_names(html):
    """The page with every container a div, and no class."""
    return re.sub(r"(</?)(?:article|footer|nav)\b", r"\1div", html).replace(' class="ad"', "")


def test_pages(spark):
    d = SMALL.replace("sf0.001", "sf0.01")
    found = queries.op9_main_text(spark, d).join(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in found:
        want = plain_article(r["html"])
        assert r["text"] == want and r["n_chars"] == len(want)
        for html in (r["html"], without_names(r["html"]), r["html"].replace("<body>", "<body><div id=wrap><div>")):
            assert htmltext.main_text(html, hints=False) == want
    rows = [(1, None), (1, None), (2, ""), (3, "<p>same, same</p><p>same, same</p>"), (4, "<div>" * 20_000 + "deep"), (5, "<article><p>" + "long, text. " * 100_000 + "</article><footer>x</footer>")]
    odd = htmltext.extract(spark.createDataFrame(rows, "page_id int, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "url")})).collect()
    assert [r["n_chars"] for r in odd] == [0, 0, 0, 21, 4, 1_199_999] and odd[3]["text"] == "same, same same, same" and odd[0]["url"] == 1
    assert htmltext.extract(spark.createDataFrame([], "page_id int, html string")).count() == 0


def test_deep_pages_take_linear_time():
    from time import process_time

    n = 20_000
    for html in ("<div>x" * n, "<ul><li>" * n + "x", "<b><p>x" * n, "<div>" * n + "</span></section>" * n, "<p>" * n, "<li>x<b>" * n):
        began = process_time()
        htmltext.main_text(html)
        assert process_time() - began < 2


# 10 -----------------------------------------------------------------------------------------------------------------


def plain_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 13 <= len(digits) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_the_patterns():
    import random

    r = random.Random(3)
    made = ["".join(r.choices("ab1290.@+-_ () 5678,\n", k=r.randint(0, 80))) for _ in range(4000)]
    for text in [*made, *TEXTS, "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x@@y.z", "9" * 60]:
        assert pii.base_spans(text) == plain_spans(text)


def test_shapes():
    text = "John's e-mail: JOHN @ Hosts\u00e9 dot COM, 7 255 256 12345678 x\u00b2 \u0663 \u65e5\u672c_"
    words = pii.words_of(["", text, "", "de"])
    names = {i: n for n, i in pii.SHAPES.items()}
    assert [(text[a:b], names[k]) for i, a, b, k in zip(words.text, words.start, words.end, words.shape) if i == 1] == [
        ("John", "title"), ("'", "other"), ("s", "lower"), ("e", "lower"), ("-", "-"), ("mail", "w mail"), (":", ":"), ("JOHN", "upper"), ("@", "@"), ("Hosts\u00e9", "title"), ("dot", "w dot"), ("COM", "w domain"),
        (",", ","), ("7", "d1"), ("255", "d3"), ("256", "d3 over"), ("12345678", "d7"), ("x\u00b2", "other"), ("\u0663", "other"), ("\u65e5\u672c", "mixed"), ("_", "_")]
    assert words.text[-1] == 3 and names[words.shape[-1]] == "w domain" and words.apart[-1]


def test_field():
    field = pii.production_field()
    right = total = wrong = 0
    for text, spans in pii.labelled(200, 99):
        words = pii.words_of([text])
        states = field.decode(words)
        begins = {(int(s - 1) // 2, int(words.start[t])) for t, s in enumerate(states) if s % 2 == 1}
        true = {(k, a) for k, a, _ in spans}
        right, total, wrong = right + len(begins & true), total + len(true), wrong + len(begins - true)
    assert right / total > 0.95 and wrong / total < 0.05
    texts = ["mail john.doe [at] mail [dot] com now", "call (988) 555-2485 now", "host 10[.]0[.]0[.]1.", "on 2024-01-05 at 10:30 for $99.95, page 12-14"]
    assert [pii.shown(every) for _, every in pii.found_spans(texts, field)] == ["email:5:33", "phone:5:19", "ip:5:19", ""]
    assert pii.shown(pii.found_spans(["Room 42 is on the left john (at) example (dot) com"], field)[0][1]) == "email:23:50"


def test_best_states_equal_enumeration():
    from itertools import product

    random = np.random.default_rng(5)
    for n in (1, 2, 3, 4):
        field = pii.Field(random.normal(size=(pii.N_FEATURES, pii.N_STATES)), random.normal(size=(pii.N_STATES + 1, pii.N_STATES)))
        for text in ("john @ 12 .", "+1 555 host com", "a 1. 7"):
            words = pii.words_of([" ".join(text.split()[:n])])
            scores = field.weights[pii.features(words)].sum(axis=1)
            assert np.allclose(scores, field.scores(words))
            if len(scores) <= 4:
                paths = list(product(range(pii.N_STATES), repeat=len(scores)))
                value = lambda p: field.moves[-1, p[0]] + sum(scores[t, s] for t, s in enumerate(p)) + sum(field.moves[a, b] for a, b in zip(p, p[1:]))
                best = max(paths, key=value)
                assert tuple(field.decode(words)) == best and tuple(field.decode(words, prune=False)) == best


def test_slopes_equal_differences():
    sample, random = pii.Sample(pii.labelled(6, 3)), np.random.default_rng(6)
    w, m = random.normal(size=(pii.N_FEATURES, pii.N_STATES)) / 5, random.normal(size=(pii.N_STATES + 1, pii.N_STATES)) / 5
    _, by_weight, by_move = sample.loss(w, m)
    seen = np.unique(sample.features)
    for _ in range(25):
        at = random.choice(seen), random.integers(pii.N_STATES)
        step = np.zeros_like(w)
        step[at] = 1e-5
        assert (sample.loss(w + step, m)[0] - sample.loss(w - step, m)[0]) / 2e-5 == pytest.approx(by_weight[at], abs=1e-7)
    for at in zip(*np.nonzero(pii.ALLOWED)):
        step = np.zeros_like(m)
        step[at] = 1e-5
        assert (sample.loss(w, m + step)[0] - sample.loss(w, m - step)[0]) / 2e-5 == pytest.approx(by_move[at], abs=1e-7)


def test_pruning_changes_no_state():
    import random

    field, r = pii.production_field(), random.Random(7)
    words = "the left of a long hall near that big old door and some more words".split()
    padded = [" ".join([r.choice(("42", "7", "@", "room 12")), *r.choices(words, k=k), text]) for text, _ in pii.labelled(150, 77) for k in range(17)]
    for texts in (TEXTS, padded, [" ".join(padded)], ["", " "], ["7 " * 9000]):
        tokens_ = pii.words_of(texts)
        assert np.array_equal(field.decode(tokens_), field.decode(tokens_, prune=False))
        assert pii.found_spans(texts, field) == [x for t in texts for x in pii.found_spans([t], field, prune=False)]
    wild = pii.Field(np.random.default_rng(8).normal(size=(pii.N_FEATURES, pii.N_STATES)), np.random.default_rng(9).normal(size=(pii.N_STATES + 1, pii.N_STATES)))
    tokens_ = pii.words_of(padded[:300])
    assert np.array_equal(wild.decode(tokens_), wild.decode(tokens_, prune=False))


def test_spans_beside_many_base_spans():
    field = pii.production_field()
    text = "mail " + "a@b.cd " * 40 + "call (988) 555-2485 now"
    assert [s for s in pii.found_spans([text], field)[0][1] if s[0] == 3] == [(3, 290, 304)]


def test_personal_data_of_odd_rows(spark):
    found = pii.find(odd_docs(spark).union(odd_docs(spark).limit(1).withColumn("text", F.lit("a@b.cd 1.2.3.4")))).collect()
    assert [r["spans"] for r in found][-1] == "email:0:6,ip:7:14" and found[-1]["masked"] == "[EMAIL] [IP]" and found[0]["spans"] == ""
    kept = pii.redact(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.where("text IS NULL").count() == 1
    assert pii.find(odd_docs(spark).limit(0)).count() == 0


# the pipeline -------------------------------------------------------------------------------------------------------


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        steps.append(docs.collect())
    scored = {r["doc_id"]: r["predicted"] for r in queries.op2_quality(spark, SMALL).collect()}
    assert {r["doc_id"] for r in steps[0]} == {d for d, p in scored.items() if p}
    assert sorted(r["doc_id"] for r in steps[1]) == plain_kept((r["doc_id"], r["text"]) for r in steps[0])
    field, before = pii.production_field(), {r["doc_id"]: r["text"] for r in steps[1]}
    for r in steps[2]:
        assert r["text"] == pii.masked(before[r["doc_id"]], pii.found_spans([before[r["doc_id"]]], field)[0][1]) and r["n_chars"] == len(r["text"])
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()}
    assert Tally(r["doc_id"] for r in steps[3]) == Tally({d: t // s for d, (t, s) in taken.items() if t})
    check_packing(steps[4], [(r["doc_id"], r["text"]) for r in steps[3]])


def plain_kept(docs):
    """The smallest id of every group that pairs of at least 0.8 join, on sets of five-word shingles."""
    sets = {}
    for ident, text in docs:
        words = (text or "").encode().lower().split()
        sets[ident] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and min(len(sets[a]), len(sets[b])) * 5 >= max(len(sets[a]), len(sets[b])) * 4 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                top[max(root(a), root(b))] = min(root(a), root(b))
    return sorted(d for d in sets if root(d) == d)


@pytest.mark.parametrize("shard", [3, jaccard.SHARD])
def test_near_duplicates_equal_brute_force_jaccard(spark, shard):
    docs = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL) if shard == jaccard.SHARD else jaccard.deduplicate(docs, shard=shard)
    assert sorted(r["doc_id"] for r in found.collect()) == plain_kept(map(tuple, docs.collect()))


def test_near_duplicates_of_repeated_and_null_ids(spark):
    copy = "one two three four five six seven"
    rows = [(1, copy), (2, copy.upper()), (None, copy), (3, "w x y z"), (3, "other words are here"), (4, "other words are here"), (None, "n o p"), (None, "N O p"), (None, None), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "key", "fp", "component", "found")})
    found = jaccard.deduplicate(docs)
    assert found.columns == docs.columns
    kept = [(r["doc_id"], r["text"]) for r in found.collect()]
    assert sorted(x for x in kept if x[0]) == [(1, copy), (3, "other words are here"), (3, "w x y z"), (9, " ")]
    assert len([x for x in kept if x[0] is None]) == 1
    assert jaccard.deduplicate(docs.limit(0)).count() == 0


def test_stages_of_odd_and_empty_documents(spark, tmp_path):
    long = "Some words here, and more of them. " * 8000
    rows = [(1, None, "en", None, None), (2, "", "en", "b", 0), (2, "", "en", "b", 0), (None, "one two three", None, "a", 13), (4, " \t\n", "de", "a", 3), (7, long, "en", "c", len(long)), (8, long + "mail a@b.cd", "en", "c", 1)]
    odd = spark.createDataFrame(rows, DOCS)
    for name, docs in (("odd", odd), ("empty", odd.limit(0))):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SMALL)
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name / str(k)))
            docs = spark.read.parquet(str(tmp_path / name / str(k)))
            assert name == "odd" or docs.count() == 0
        if name == "odd":
            assert sum(r["length"] for r in docs.collect()) > 0
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, odd, SMALL).collect()} == {1, None, 7, 8}
    assert [r["text"][-7:] for r in corpus_pipeline.mask_personal_data(spark, odd, SMALL).where("doc_id = 8").collect()] == ["[EMAIL]"]
    assert tokencount.count_tokens(odd.limit(0)).count() == 0
    whole = tokencount.count_tokens(odd.where("doc_id = 7")).first()
    assert whole["n_tokens"] == 9 * 8000 and whole["over_limit"]
