"""Null, empty, long, tied and repeated rows, empty tables and extra columns, for each operator; results against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm._base import _CLEANUP, written
from flowlens.llm import chat, exact_dedup, html_extract, line_dedup, mixing, ngram_join, quality, suffix_dedup, token_store, word_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the quick brown fox jumps over the lazy dog and then runs far away from all of the other animals in the big dark wood until night falls"
TEXTS = [
    None, "", " \n\t", "one", BASE, BASE, BASE.replace("lazy", "tired"), BASE.upper(), f"{BASE}\n{BASE}\nand more", "x" * 250, "ab" * 300, "é" * 120, "<|endoftext|> a<|endoftext|>",
    "it's 12 34 x  y\x85z", "w " * 9000, "漢字 テスト １２ ﬁ İstanbul", f"{BASE} {BASE}", f"Start {BASE}.\nEnd", "#*$ %&| <>" * 20,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, keep_id long, kept boolean, bucket long, list long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", [None, "a", "b"][i % 3], 0, 1, 2, 3, True, 4, 5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(4, 1, 0), (8, 0, 0), (9, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.judge(docs, model).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        win = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {p for k in range(len(w) - 4) if win[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[i][c] for c in quality.BASE) == want
        assert got[i].base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (got[i].base_failed and got[i].kept)
    assert quality.judge(none, model).count() == 0 and quality.keep_good(none, model).count() == 0
    assert quality.train(none, labels).score(np.zeros((2, len(quality.FEATURES)))).tolist() == pytest.approx([0.999, 0.999])
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_trees_keep_to_monotone_constraints():
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(3000)) < 0.8).astype(float)
    model = quality.fit(x, y, np.array([-1, 0, 1, 0]))
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    for f, sign in ((0, -1), (2, 1)):
        grid = np.repeat(rng.random((50, 4))[:, None, :], 40, axis=1)
        grid[:, :, f] = np.linspace(0, 1, 40)
        s = model.score(grid.reshape(-1, 4)).reshape(50, 40)
        assert (sign * np.diff(s, axis=1) >= -1e-12).all()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.col("doc_id") % 2 == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, labels.where(~held))
    got = quality.judge(docs, model).join(labels.where(held), "doc_id").select("score", "quality").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) > 0.97


@pytest.mark.parametrize("most", [3])
def test_source_targets(spark, most):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 300, None: 50, "e": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * sizes[s]
        left = sum(sizes.values()) - sum(target.values())
        open_ -= over
    assert got == pytest.approx(target)


def test_mixing(spark, none):
    rows = [(i, "w " * (1 + i * 7919 % 97), f"s{i % 4}" if i % 5 else None) for i in range(1500)] + [(7, None, "s1"), (None, "a b", "s2"), (3, "same row", "s9"), (3, "same row", "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    run = lambda **p: sorted((str(r.doc_id), r.size, r.copies, r.taken, r.rows, str(r.source), round(r.target, 6), r.source_size) for r in mixing.mix(df, **p).collect())
    got = run(leaf_units=64, fan=4)
    assert got == run(leaf_units=64, fan=4) and got != run(leaf_units=64, fan=4, seed=12)
    assert sum(r[4] for r in got) == len(rows)
    for s in {r[5] for r in got}:
        own = [r for r in got if r[5] == s]
        assert abs(sum(r[3] * r[4] for r in own) - own[0][6]) <= max(r[1] * r[4] for r in own)
        ratio = own[0][6] / own[0][7]
        assert all(r[2] in (int(ratio), int(ratio) + 1) and r[3] <= 3 * r[1] for r in own if r[1])
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).columns == none.columns
    taken = Counter(r.doc_id for r in mixing.mixed_rows(df, leaf_units=64, fan=4).collect())
    assert sum(taken.values()) == sum(r[2] * r[4] for r in got)


def test_pivot_keeps_mass_and_chances():
    rng, total = np.random.default_rng(1), np.zeros(30)
    p, size = rng.random(30), rng.integers(1, 50, 30).astype(float)
    for _ in range(3000):
        pivot, out = mixing.Pivot(), {}
        for i in range(30):
            out |= dict(pivot.add(i, size[i], p[i], rng.random()))
        if pivot.held:
            i, _, q = pivot.held
            assert abs(sum(size[k] * v for k, v in out.items()) + size[i] * q - (size * p).sum()) < 1e-6
            out[i] = int(rng.random() < q)
        total += [out[i] for i in range(30)]
    assert np.abs(total / 3000 - p).max() < 0.05


def test_word_bpe(docs, none):
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    for r in word_bpe.encode_decode(docs, path).collect():
        ids = t.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, t.decode(ids, skip_special_tokens=False))
    assert word_bpe.encode_decode(none, path).count() == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav><!-- no -->
    <div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>First  part<br>goes on &eacute;&#233;.<p>Short.<form><input name=q>Ask</form><p><b>Bold</b> text.</p></article>
    <aside>Side</aside><section class="comments"><p>I liked it very much indeed</p></section><footer>&copy; 2020</footer>"""
    assert html_extract.extract(page) == "Head & line\nFirst part goes on éé.\nShort.\nBold text."
    assert html_extract.extract("") == html_extract.extract("<p") == html_extract.extract("<nav>x</nav>") == ""
    plain = "<body><div><a href=a>One</a> <a href=b>Two</a></div><div id=c><p>" + "Long text with many words. " * 9 + "<p>Short.<p>" + "More of the same text. " * 9 + "</div><div id=footer>F</div>"
    assert html_extract.extract(plain).split("\n")[1] == "Short."


def test_html_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>Hello there</p>"), (2, "v", "<article>" + "a b " * 50_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = sorted((str(r.page_id), r.n_chars, len(r.text)) for r in html_extract.extract_pages(df).collect())
    assert got == [("1", 0, 0), ("1", 0, 0), ("2", 199_999, 199_999), ("None", 11, 11)]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "num", "cap"), [(3, 90, 256), (5, 80, 256), (2, 80, 4)])
def test_ngram_join(spark, docs, none, width, num, cap):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in rng.integers(0, 400, 200)]
    texts = list(TEXTS)
    for _ in range(25):
        w = list(base)
        for k in rng.integers(0, 200, rng.integers(0, 6)):
            w[k] = f"z{rng.integers(0, 9)}"
        texts.append(" ".join(w[: 200 - rng.integers(0, 12)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ent", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df, width, num, 100, cap=cap).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, width, num, 100)
    if cap == 256:
        assert ngram_join.ngram_components(none, width, num, 100).count() == 0
        left = {r.doc_id for r in ngram_join.keep_one_of_each(df, width=width, num=num, den=100).collect()}
        assert left == {i for i, (_, c) in got.items() if c == i}


def test_trie_and_segments():
    rng = np.random.default_rng(2)
    for trial in range(120):
        base = [rng.integers(0, 2**63, rng.integers(1, 120)).astype(np.uint64) for _ in range(3)]
        sets = {}
        for _ in range(rng.integers(2, 25)):
            s = set(base[rng.integers(0, 3)].tolist()) | set(base[0][:3].tolist())
            for _ in range(rng.integers(0, len(s) // 8 + 2)):
                s.discard(next(iter(s), None))
                s.add(int(rng.integers(0, 2**63)))
            a = np.array(sorted(s), np.uint64)
            sets[a.tobytes()] = a
        sets = list(sets.values())
        for num in (80, 90):
            links = set(map(frozenset, ngram_join.trie_links(sets, num, 100)))
            keys = [set(ngram_join.path_segments(s, num, 100).tolist()) for s in sets]
            comp = {i: i for i in range(len(sets))}
            find = lambda i: i if comp[i] == i else find(comp[i])  # noqa: B023,E731
            for i, j in map(tuple, links):
                comp[find(i)] = find(j)
            for i in range(len(sets)):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    linked = 100 * both >= num * (len(sets[i]) + len(sets[j]) - both)
                    assert linked or frozenset((i, j)) not in links
                    assert not linked or (find(i) == find(j) and keys[i] & keys[j]), trial


@pytest.mark.parametrize("share", [0.35, 1.0])
def test_sets_that_may_link_are_never_left_out(spark, share):
    rng = np.random.default_rng(5)
    base = [[f"w{k}" for k in rng.integers(0, 5000, rng.integers(3, 150))] for _ in range(40)]
    texts = ["", "one", " ".join(base[0])]
    for w in base * 3:
        w = list(w)
        for k in rng.integers(0, len(w), rng.integers(0, len(w) // 10 + 2)):
            w[k] = f"z{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    packed, _ = written(ngram_join.sampled_grams(df, 5, 16, share))
    ents = {r.doc_id: r.ent for r in packed.where("part IS NULL").collect()}
    left = {r.ent for r in ngram_join.not_alone(packed, 4, 80, 100).collect()}
    own = {}
    for i, (_, c) in enumerate(brute_components(texts, 5, 80, 100)):
        own.setdefault(c, set()).add(ents[i])
    linked = {i for i, (_, c) in enumerate(brute_components(texts, 5, 80, 100)) if len(own[c]) > 1}
    assert len(ents) == len(texts) and {ents[i] for i in linked} <= left
    assert linked and len(left) < len(texts) - 10


def test_a_common_line_brings_no_documents_together(spark, monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    rows = [(i, " ".join([f"c{k}" for k in range(12)] + [word() for _ in range(60)])) for i in range(60)]
    rows += [(100 + i, " ".join([f"d{k}" for k in range(80)] + [word()])) for i in range(3)]
    seen, whole = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda sig, *more: seen.append(sig.select("ent").distinct().count()) or whole(sig, *more))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 100 if i >= 100 else i for i, _ in rows}
    assert seen == [3]


def test_shuffles_go_once_they_are_written(spark):
    def known():
        """Shuffles of the session that are still there."""
        return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, conf = known(), spark.conf.get(_CLEANUP, None)
    out, _ = written(df)
    assert known() <= before and spark.conf.get(_CLEANUP, None) == conf
    assert out.count() == 7 and df.count() == 7


def test_exact_dedup(docs, none):
    texts = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in enumerate(TEXTS)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, digest_all=True).collect()}
    for i, _, n in texts:
        same = [(-len(t), k) for k, t, m in texts if m == n]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(same)[1], len(same), min(same)[1] == i)
        assert got[i].text_sha256 == hashlib.sha256(n.encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0
    left = exact_dedup.keep_first_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("filters", [True, False])
def test_keep_first_copies_of_repeated_ids(spark, request, filters):
    if not filters:
        request.getfixturevalue("all_may_be_in")
    rows = [(1, "a b"), (1, "a b"), (1, "other"), (2, "ab"), (2, "a  b"), (2, " ab "), (None, "x y"), (None, "x y"), (None, "ab"), (3, "other"), (4, None), (5, ""), (6, "alone"), (None, "alone 2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__rows", F.lit(1)).repartition(3)
    out = exact_dedup.keep_first_copies(df)
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    assert out.columns == df.columns and len(got) == 6
    assert [g for g in got if "a" not in g[1] or "alone" in g[1]] == sorted([("None", "x y"), ("1", "other"), ("4", "None"), ("6", "alone"), ("None", "alone 2")])
    assert [g for g in got if g[0] == "2"][0][1].count(" ") == 2  # the longest original, of a tie the greater hash


def test_token_store(spark, docs, none, tmp_path):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    token_store.write_store(docs, f"file://{tmp_path}/store", path, 2)
    got = {r.doc_id: r for r in token_store.stored_documents(spark, f"file://{tmp_path}/store").collect()}
    whole = {bytes(r.root): r.ids for r in token_store.read_store(spark, f"file://{tmp_path}/store").collect()}
    recipes = {r.doc_id: bytes(r.root) for r in spark.read.parquet(f"{tmp_path}/store/recipes").collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert np.frombuffer(whole[recipes[i]], token_store.WIDTH).tolist() == ids
        start += len(ids)
    chunks = token_store.stored_chunks(spark, f"file://{tmp_path}/store")
    assert chunks.count() == chunks.select("sha").distinct().count()
    token_store.write_store(none, f"file://{tmp_path}/none", path, 2)
    assert token_store.stored_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_damaged_chunk_is_found(spark, docs, tmp_path):
    from pyspark.errors import PySparkException

    at = f"file://{tmp_path}/store"
    token_store.write_store(docs.limit(5), at, P.path("byte_bpe_50k.json"), 2)
    chunks = token_store.stored_chunks(spark, at).withColumn("ids", F.concat("ids", F.unhex(F.lit("0100")))).collect()
    bad = spark.createDataFrame(chunks, "sha binary, ids binary").withColumns({"row": F.lit(1).cast("long"), "doc_id": F.lit(1).cast("long"), "pos": F.lit(1), "n": F.lit(1)})
    bad.write.mode("overwrite").parquet(f"{at}/stored/kind=chunk")
    with pytest.raises(PySparkException):
        token_store.stored_documents(spark, at).collect()


def test_lost_recipes_and_chunks_are_found(spark, docs, tmp_path):
    from pyspark.errors import PySparkException

    at = f"file://{tmp_path}/store"
    token_store.write_store(docs, at, P.path("byte_bpe_50k.json"), 2)
    chunks = spark.read.parquet(f"{at}/stored/kind=chunk").collect()
    spark.createDataFrame(chunks[1:], spark.read.parquet(f"{at}/stored/kind=chunk").schema).write.mode("overwrite").parquet(f"{at}/stored/kind=chunk")
    with pytest.raises(PySparkException):
        token_store.stored_documents(spark, at).collect()
    recipes = spark.read.parquet(f"{at}/recipes").collect()
    spark.createDataFrame(recipes[:-1], spark.read.parquet(f"{at}/recipes").schema).write.mode("overwrite").parquet(f"{at}/recipes")
    with pytest.raises(RuntimeError):
        token_store.stored_documents(spark, at)


def test_merkle_roots():
    def plain(leaves):
        level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
        while len(level) > 1:
            level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
        return level[0]

    for n in range(40):
        leaves = [bytes([k]) for k in range(n)]
        assert token_store.merkle(leaves) == plain(leaves)


def test_piece_encoder_equals_the_library():
    path = P.path("byte_bpe_50k.json")
    rng = np.random.default_rng(12)
    some = ["a", "b", "the", "I'll", "'S", "12", "½", "é", "ß", "漢字", "\u0301", "İ", "!", "#$", "\xad", "ª", "ʰ", "ԱԲ", "😀", "<|endoftext|>", "<|"]
    space = [" ", " ", " ", "\n", "\n", "  ", "\n\n", " \n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u2028", "\u3000", "", ""]
    texts = ["a\tb\tc\n\n", "name\tvalue\nx\ty\n\n", "a\tb\n\n\x0cc", "A\u3000B\u3000C\n\n", "a\x1fb\n"]
    for _ in range(6000):
        texts.append("".join(str(rng.choice(some)) + str(rng.choice(space)) for _ in range(rng.integers(0, 9))))
    t = Tokenizer.from_file(path)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    encoder = token_store.PieceEncoder(path, most=500)
    for lo in range(0, len(texts), 1000):
        ids, ends = encoder.encode(pa.array(texts[lo : lo + 1000]), np.array([2], token_store.WIDTH).tobytes())
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*w, 2] for w in want[lo : lo + 1000]]


def brute_removed(texts, width=100):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - width + 1):
            if raw[i : i + width] in seen:
                gone[i] += 1
                gone[i + width] -= 1
            seen.add(raw[i : i + width])
        m = np.cumsum(gone)[:-1] > 0
        out.append((len(raw), int(m.sum()), int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, m, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("shard", "hot"), [(500_000, 20_000), (500, 20_000), (500, 2)])
def test_suffix_dedup(spark, docs, none, shard, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_bytes(docs, shard_bytes=shard, hot_parts=hot).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute_removed(TEXTS)
    assert suffix_dedup.removed_bytes(none).count() == 0


@pytest.mark.parametrize(("width", "hot"), [(100, 20_000), (100, 3), (200, 20_000)])
def test_suffix_dedup_of_common_passages(spark, width, hot):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdeé "), 6))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for k in range(40):
        w = [word() for _ in range(rng.integers(0, 40))]
        own = passage if k % 3 else "".join(c if rng.random() > 0.01 else "z" for c in passage)
        texts.append(" ".join([*w, own[: rng.integers(50, len(own))], *w[::-1], *([passage] if k % 5 == 0 else [])]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, rows[3], rows[7]], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_bytes(df, width=width, shard_bytes=3000, hot_parts=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, width)


@pytest.fixture
def all_may_be_in(monkeypatch):
    """The filters before joins let all rows pass, as they may."""
    for module in (exact_dedup, line_dedup, ngram_join, suffix_dedup):
        if hasattr(module, "may_be_in"):
            monkeypatch.setattr(module, "may_be_in", lambda rows, key, wanted, out: rows.withColumn(out, F.lit(True)))


def test_suffix_dedup_without_filters(docs, all_may_be_in):
    rows = suffix_dedup.removed_bytes(docs).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(TEXTS) and [got[i] for i in range(len(TEXTS))] == brute_removed(TEXTS)


def test_long_texts_are_cut_into_overlapping_pieces():
    rng = np.random.default_rng(8)
    raw = [bytes(rng.integers(97, 100, n, np.uint8)) for n in (0, 50, 5000, 130, 1)]
    for width, most in ((100, 300), (40, 128)):
        want = {(i, k) for i, x in enumerate(raw) for k in range(len(x) - width + 1)}
        got = []
        for of, at, data, ends in suffix_dedup._pieces(raw, width, most):
            assert len(data) <= 2 * (most + width)
            _, _, first, last = suffix_dedup.anchors(data, ends, width)
            for a, z in zip(first.tolist(), last.tolist(), strict=True):
                k = int(np.searchsorted(ends, a, side="right"))
                start = int(ends[k - 1]) if k else 0
                got += [(int(of[k]), int(at[k]) + p - start) for p in range(a, z + 1)]
        assert len(got) == len(want) and set(got) == want


def test_suffix_array_repeats():
    rng = np.random.default_rng(4)
    for _ in range(30):
        width = int(rng.choice([40, 100]))
        base = bytes(rng.choice(list(b"ab \n"), 400).tolist())
        parts = [base[i : i + n] for i, n in zip(rng.integers(0, 300, 8), rng.integers(1, 220, 8), strict=True)] + [b"ab" * 70]
        seen, want = set(), []
        for p in parts:
            want.append([i for i in range(len(p) - width + 1) if p[i : i + width] in seen or seen.add(p[i : i + width])])
        got, (text, at) = suffix_dedup.repeats(parts, width, [])
        assert [g.tolist() for g in got] == want and [text[i : i + width].tobytes() for i in at.tolist()] == sorted(seen)
        first, old = suffix_dedup.repeats(parts[:4], width, [])
        second, more = suffix_dedup.repeats(parts[4:7], width, [old])
        third, _ = suffix_dedup.repeats(parts[7:], width, [old, more])
        assert [g.tolist() for g in first + second + third] == want


def test_chat(spark):
    rows = [
        (1, 0, "system", "be nice"), (1, 1, "user", "a & b <|im_end|>\n<|im_start|>"), (1, 2, "assistant", "&lt;| <"), (2, 1, "assistant", "first"), (2, 0, None, None), (3, 0, "user", "x" * 100_000),
        (4, 0, "user", "q"), (4, 0, "user", "q"), (None, 0, "user", "n"), (5, None, "user", "q"), (5, 1, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(df).select("conv_id", "valid", chat.formatted(F.col("segments")).alias("whole"), chat.learned(F.col("segments")).alias("loss"))
    got = {r.conv_id: r for r in out.select("*", chat.parse_chats(F.col("whole")).alias("turns")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in own]
        assert got[c].loss == "".join(x for _, _, r, x in own if r == "assistant")
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False, 5: True}
    assert chat.format_chats(df.limit(0)).count() == 0


def test_line_dedup(spark, none):
    line = "this is a rather long line of text that says the same thing with very small changes at the end of day"
    texts = [f"{line}\nunique words stand here alone\n\n{line}", f"{line.replace('small', 'smell')}\nanother one entirely different from the rest", None, "", "short", f"  {line.upper()}  ", "漢字かな交じり文の例です。これは長い行です。"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pos", F.lit(1))
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.repeated_lines(df).collect()}
    assert got == {0: (3, 1, [3]), 1: (2, 1, [0]), 2: (0, 0, []), 3: (0, 0, []), 4: (1, 0, []), 5: (1, 1, [0]), 6: (1, 0, [])}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert out[0] == f"{line}\nunique words stand here alone\n" and out[2] is None and out[5] == "" and out[4] == "short"
    assert line_dedup.repeated_lines(none).count() == 0


def test_line_dedup_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b\nc d")], "doc_id long, text string")
    plan = line_dedup.repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_line_dedup_finds_similar_lines_of_all_kinds(spark):
    rng = np.random.default_rng(3)
    word = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choice(list(of), n))
    thai = "".join(map(chr, range(0x0E01, 0x0E2F)))
    kinds = {
        "one word": lambda: (w := word(30), f"{w}{word(3)}"),
        "word appended": lambda: (w := word(40), f"{w} {word(3)}"),
        "changed prefix": lambda: (w := f"{word(20)} {word(20)}", f"{word(2)}{w[2:]}"),
        "url": lambda: (w := f"https://{word(9)}.example/{word(14)}?id={word(4, '0123456789')}", w[:-2] + word(2, "0123456789")),
        "row": lambda: (w := ",".join(word(3, "0123456789") for _ in range(12)), w[:-2] + word(2, "0123456789")),
        "thai": lambda: (w := word(40, thai), f"{word(2, thai)}{w[2:]}"),
        "short": lambda: (w := word(9), f"{w}{word(1)}"),
        "sentence": lambda: (w := " ".join(word(int(k)) for k in rng.integers(2, 9, 20)), f"{w[:50]}{word(2)}{w[52:]}"),
    }
    pairs = [(kind, *make()) for kind, make in kinds.items() for _ in range(150)]
    grams = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    similar = [(k, x, y) for k, x, y in pairs if x != y and 5 * len(grams(x) & grams(y)) >= 4 * len(grams(x) | grams(y))]
    assert min(Counter(k for k, _, _ in similar).values()) > 100
    df = spark.createDataFrame([(i, f"{x}\n{y}") for i, (_, x, y) in enumerate(similar)], "doc_id long, text string")
    found = {r.doc_id for r in line_dedup.repeated_lines(df).where("n_removed = 1").collect()}
    assert len(found) >= 0.99 * len(similar)
    of, hit = Counter(k for k, _, _ in similar), Counter(k for i, (k, _, _) in enumerate(similar) if i in found)
    assert all(hit[k] >= 0.97 * n for k, n in of.items())


def test_html_text_outside_articles():
    text = [f"Paragraph {k} of the main text is long, " + "with many words in it that nobody links to " * 6 + "." for k in range(6)]
    main = "<div id=c>" + "".join(f"<p>{x}</p>" for x in text) + "</div>"
    cards = "".join(f"<article><h3><a href=t{k}>Teaser {k}</a></h3><p>A few words on it.</p></article>" for k in range(3))
    assert html_extract.extract(f"<body>{main}<div>{cards}</div></body>").split("\n") == text
    # A named article that outweighs the rest is taken whole, short blocks too.
    assert html_extract.extract(f"<body><article><h1>Head</h1>{main}<p>End.</p></article><p>{text[0]}</p></body>").split("\n") == ["Head", *text, "End."]


@pytest.mark.parametrize("wrap", ["<div class='layout has-sidebar'>{}</div>", "<div class='no-nav'>{}</div>", "<div class=sidebar>{}</div>", "<form id=f>{}</form>", "<header><div class='ad x'>{}</div></header>", "{}"])
@pytest.mark.parametrize("tag", ["article class='post tag-social comment-open'", "main id='related-works'", "article class=related", "main role=search", "article"])
def test_html_never_skips_an_article(wrap, tag):
    own = f"<{tag}><h1>Head</h1><p>Text <span class=ad>Buy</span>goes on.</p><div class=comments><article class=comment><p>I liked it</p></article></div></{tag.split()[0]}>"
    assert html_extract.extract(f"<body><nav>Menu</nav><div class='ad x'>Buy now</div>{wrap.format(own)}<footer>F</footer></body>").startswith("Head\nText goes on.")


def test_html_skips_named_boilerplate():
    page = "<body><div class='big sidebar'>Side</div><article><p>Text of it.</p><div class=comments><article class=comment><p>I liked it</p></article></div></article><div id=footer>F</div></body>"
    assert html_extract.extract(page) == "Text of it."


def test_null_id_bridges_two_documents(spark):
    w = [f"w{k}" for k in range(60)]
    rows = [(5, " ".join(w[:50])), (None, " ".join(w[4:54])), (9, " ".join(w[8:58]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(46)} for _, t in rows]
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert near(0, 1) and near(1, 2) and not near(0, 2)
    assert [r.component_id for r in ngram_join.ngram_components(df).collect()] == [5, 5, 5]


def test_bucket_members_shuffle_once(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 700).alias("bucket"), F.xxhash64("id").alias("ent")).write.parquet(f"{tmp_path}/sig")
    df = line_dedup.bucket_members(spark.read.parquet(f"{tmp_path}/sig"))
    assert len(df.collect()) == 1300
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_line_dedup_finds_similar_lines_of_all_lengths(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    prose = lambda n: " ".join(word(int(k)) for k in rng.integers(2, 9, n // 6 + 1))[:n].strip()
    # Lines near both limits of the two signatures, long ones, and long ones that repeat their few shingles.
    pairs = [(x, f"{x[: n // 2]}{word(2)}{x[n // 2 + 2 :]} {prose(n // 14)}") for n in (46, 52, 60, 80, 96, 104, 110, 120, 200, 500) for x in [prose(n) for _ in range(60)]]
    pairs += [((w := word(k)) * 3, f"{w * (400 // k)}") for k in (12, 20, 40) for _ in range(40)]
    grams = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
    similar = [(x, y) for x, y in pairs if x != y and 5 * len(grams(x) & grams(y)) >= 4 * len(grams(x) | grams(y))]
    assert len(similar) > 400
    df = spark.createDataFrame([(i, f"{x}\n{y}") for i, (x, y) in enumerate(similar)], "doc_id long, text string")
    assert line_dedup.repeated_lines(df).where("n_removed = 1").count() >= 0.99 * len(similar)


@pytest.mark.parametrize("cap", [4, 4096])
def test_line_dedup_of_a_large_group(spark, cap):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5))
    base = [word() for _ in range(40)]
    lines = [" ".join(word() if rng.random() < rate else w for w in base) for rate in (0.03, 0.06, 0.1) for _ in range(50)]
    of = brute_lines(lines)
    got = {r.doc_id: r.n_removed for r in line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), cap=cap).collect()}
    # No line is removed that nothing links, and at most one in a hundred is missed.
    assert all(of[i] != i for i, n in got.items() if n) and sum(got.values()) >= 0.99 * sum(c != i for i, c in of.items())


def brute_lines(lines):
    """Of each line the first of its component."""
    sets = [{x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in lines]
    comp = list(range(len(lines)))
    for i, x in enumerate(sets):
        for j in range(i):
            if comp[i] != comp[j] and 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return dict(enumerate(comp))
