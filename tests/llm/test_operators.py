"""Operators against brute force on the smallest tables and on small awkward ones."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codonloom.llm import (bitmaps, decontaminate, entries, graph, induced, lm, packing, quality, secrets, sharding, similar, simhash, suffixes,
                           toxicity, urls)

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

LONG = " ".join(f"wort{i}" for i in range(3000))
PASSAGE = " ".join(f"alpha{i} beta{i * 7}" for i in range(30))
AWKWARD = [
    (1, PASSAGE + " one", "en", "a", 0), (2, None, "en", None, 0), (3, "", "en", "b", 0), (4, PASSAGE + " one", "en", "a", 0),
    (5, "  \n\t ", "en", "a", 0), (6, LONG, "en", "a", 0), (6, LONG, "en", "a", 0), (None, "short", None, "a", 0),
    (8, "x" * 900, "en", "c", 0), (9, "before " + PASSAGE + " after that", "de", "a", 0), (10, "token = abcdef é password=12", "en", "a", 0),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).withColumns({c: F.lit(1) for c in ("component", "score", "fp", "blob")}).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()


def fingerprint(text, width):
    words = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    runs = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    counts = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def test_golay_keys_meet_within_one_bit():
    values = np.random.default_rng(3).integers(0, 1 << 22, 2000)
    keys = simhash.golay_keys(values)
    for bit in range(22):
        near = simhash.golay_keys(values ^ (1 << bit))
        assert (near == keys[:, :1]).any(axis=1).all()


def test_links_find_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    flips = [int(np.bitwise_xor.reduce([1 << int(b) for b in rng.choice(63, k, replace=False)] or [0])) for k in rng.integers(0, 5, 400)]
    values = sorted({int(base[i % 40]) ^ f for i, f in enumerate(flips)})
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= 3}
    found = simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint")).distinct().collect()
    assert {(r.a, r.b) for r in found} == want


@needs_tables
def test_simhash_query(spark, real):
    got = {r.doc_id: r for r in entries.op1_simhash_groups(spark, FOLDER).collect()}
    prints = {r.doc_id: fingerprint(r.text, 3) for r in real}
    component = {d: d for d in prints}
    for _ in prints:
        new = {d: min(component[o] for o in prints if (prints[o] ^ prints[d]).bit_count() <= 3) for d in prints}
        if new == component:
            break
        component = new
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", component[d]) for d in prints}


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (None, 3), (1, 2)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 180)}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


@needs_tables
def test_quality_counts(spark, real):
    for r in real:
        words = WORD.findall(r.text)
        windows = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        assert quality.rule_counts(r.text.encode()) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(inside))


@needs_tables
def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = entries.op2_quality_rules(spark, folder).drop("quality").join(labels, "doc_id").collect()
    assert sum(r.kept for r in judged if r.quality == 0) <= 2
    open_ = [r for r in judged if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in open_) >= 0.98 * len(open_)
    scored = entries.op5_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in scored if r.toxic == 1]
    bad = [r.score for r in scored if r.toxic == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.85 and all(0 <= r.score <= 1 for r in scored)


def test_windows_with_benchmark_passages(spark, docs):
    items = [(1, PASSAGE), (2, " ".join(f"gamma{i}" for i in range(20))), (3, "too short"), (4, None), (5, PASSAGE.upper())]
    found = decontaminate.matches(docs, spark.createDataFrame(items, "item_id int, text string")).collect()
    assert {(r.doc_id, r.item_id, r.similarity, r.start) for r in found} == {(d, i, 1.0, s) for d, s in ((1, 0), (4, 0), (9, 1)) for i in (1, 5)}


@needs_tables
def test_decontamination_finds_all_similar_windows(spark, real):
    items = [(r.item_id, r.text.lower().split()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def runs(words):
        return collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))

    want = {}
    for r in real:
        words = [w for w in WORD.findall(r.text.lower())]
        present = {tuple(words[i:i + 5]) for i in range(len(words) - 4)}
        for item, wanted in items:
            target = runs(wanted)
            if not present & set(target):
                continue
            for i in range(max(1, len(words) - len(wanted) + 1)):
                have = runs(words[i:i + len(wanted)])
                share = sum((have & target).values()) / max(1, sum((have | target).values()))
                if share >= 0.8 and share > want.get((r.doc_id, item), 0):
                    want[r.doc_id, item] = share
    got = {(r.doc_id, r.item_id): r.similarity for r in entries.op3_decontamination(spark, FOLDER).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def base_spans(text):
    kinds = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    found = []
    for order, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                found.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


@needs_tables
def test_secret_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = entries.op4_secret_scan(spark, folder).collect()
    assert {r.doc_id: r.base_sha256 for r in got} == {d: hashlib.sha256(base_spans(t).encode()).hexdigest() for d, t in texts.items()}


def test_ledger_scans_new_pairs_only(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = spark.createDataFrame([("a", "é token=abcdef"), ("b", "é token=abcdef"), ("c", None)], "path string, text string")
    found = secrets.scan(first, ledger)
    assert [(r.rule, r.start, r.stop) for r in found.collect()] == [("assign", 2, 14)]
    seen = spark.read.parquet(f"{ledger}/scanned").count()
    assert seen == 2 * len(secrets.RULES)
    secrets.scan(first, ledger)
    assert spark.read.parquet(f"{ledger}/scanned").count() == seen
    newer = (secrets.Rule("assign", secrets.RULES[0].pattern, version=2, group=2, least=6), *secrets.RULES[1:])
    assert secrets.scan(first, ledger, newer).count() == 1
    assert spark.read.parquet(f"{ledger}/scanned").count() == seen + 2
    held = {r.path: len(r.spans) for r in secrets.spans_by_path(first, found).collect()}
    assert held == {"a": 1, "b": 1, "c": 0}


def test_repeated_rows_have_the_spans_of_one(spark, tmp_path):
    text = "é password=abcdef then token=ghijkl end"
    rows = spark.createDataFrame([(1, text)] * 3 + [(2, "clean")] * 2, "doc_id bigint, text string").repartition(3)
    found = secrets.scan(rows, str(tmp_path / "ledger"), path="doc_id")
    assert sorted((r.rule, r.start, r.stop) for r in found.collect()) == [("assign", 2, 17), ("assign", 23, 35)]
    masked = corpus_pipeline.mask_secrets(spark, rows, "").collect()
    assert sorted(r.text for r in masked) == ["clean"] * 2 + ["é [secret] then [secret] end"] * 3


def test_private_keys_are_masked_with_their_bodies(spark):
    body = "\nProc-Type: 4,ENCRYPTED\n\n" + "MIIEow+IBAA/KC-AQEA\n" * 2000
    def key(kind, end=True):
        return f"-----BEGIN {kind}-----{body}" + f"-----END {kind}-----" * end

    texts = {1: f"a {key('RSA PRIVATE KEY')} b", 2: f"a {key('PGP PRIVATE KEY BLOCK')} b {key('PRIVATE KEY')} c",
             3: f"a {key('EC PRIVATE KEY', end=False)}", 4: f"a {key('PUBLIC KEY')} b"}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, rows, "").collect()}
    assert got == {1: "a [secret] b", 2: "a [secret] b [secret] c", 3: "a [secret]", 4: texts[4]}


@pytest.mark.parametrize("n", [1, 2, 7, 16, 1000])
def test_feistel_is_a_permutation(spark, n):
    rows = spark.range(n).select("id", sharding.permuted("id", n, 3).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert {r.id: (r.p % 16, r.p // 16) for r in rows} == {i: sharding.locate(i, n, 16, 3) for i in range(n)}


@needs_tables
def test_shards(spark, real):
    rows = entries.op6_feistel_shards(spark, FOLDER).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and sum(map(len, slots.values())) == len(real)
    texts = {r.doc_id: r.text.encode() for r in real}
    assert all(r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) for r in rows)


def test_urls_follow_their_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "https://a.example.org/x?q=1#top", link.format("http://b.example.net/es/1")), (2, "http://b.example.net/es/1", None),
        (3, "http://C.example.org/y", '<meta http-equiv="refresh" content="0; url=/z">'), (4, "https://c.example.org/z#end", link.format("https://www.shop.com/")),
        (5, "http://d.example.org/", link.format("http://b.example.net/es/1") + '<meta http-equiv="refresh" content="0;url=http://e.com/">'),
        (6, None, None), (7, "no scheme", ""), (8, "http://www.example.com/en/1", ""), (9, "http://m.example.com/en/1", ""), (10, "http://com", ""),
        (8, "http://www.example.com/en/1", ""),
    ]
    rows = urls.judge(spark.createDataFrame(pages, "page_id int, url string, html string"), entries.URL_RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    # Pages 1, 2 and 5 are one class with the allowed e.com: explicit allow wins where no own rule speaks.
    assert got[1] == ("a.example.org", "/x", None, "allow") and got[2] == ("b.example.net", "/es/1", "net/es/", "block")
    assert got[3][2:] == (None, "allow") and got[6] == got[7] == ("", "", None, "allow") and got[10] == ("com", "", None, "allow")
    assert got[8][2:] == ("www.example.com/en/", "allow") and got[9][2:] == ("example.com/en/", "block")
    fewer = urls.judge(spark.createDataFrame(pages[:2], "page_id int, url string, html string"), entries.URL_RULES).collect()
    assert {r.page_id: r.verdict for r in fewer} == {1: "block", 2: "block"}


def test_lm_scores_prefer_the_target(spark, docs):
    rows = [(i, "the cat sat on the mat") for i in range(20)] + [(100 + i, "zq%% xx## vv!!") for i in range(20)] + [(200, None), (201, "")]
    table = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in lm.score(table, spark.createDataFrame([(i,) for i in range(10)], "doc_id int")).collect()}
    assert got[15].score < 0 < got[105].score and got[200].n_tokens == got[201].n_tokens == 1
    assert lm.score(docs, spark.createDataFrame([], "doc_id bigint")).filter("abs(score) > 1e-6").count() == 0


def trigram_losses(texts):
    """Bits of every trigram of the texts after Witten-Bell smoothing, from the texts alone."""
    points = [["^", "^", *t, "^"] for t in texts]
    vocabulary = {c for p in points for c in p}

    def bits(counts):
        def level(grams, low):
            total, kinds = collections.Counter(), collections.Counter()
            for g, n in grams.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += min(n, 1)
            return {g: (n + (kinds[g[:-1]] if total[g[:-1]] else 1) * low[g[1:]]) / (total[g[:-1]] + (kinds[g[:-1]] if total[g[:-1]] else 1))
                    for g, n in grams.items()}

        one, two = collections.Counter(), collections.Counter()
        for g, n in counts.items():
            one[g[2:]] += n
            two[g[1:]] += n
        return {g: -np.log2(p) for g, p in level(counts, level(two, level(one, {(): 1 / len(vocabulary)}))).items()}

    return points, bits


@pytest.mark.parametrize("block_bytes", [1, 40, lm.BLOCK_BYTES])
def test_losses_and_scores_by_brute_force(spark, block_bytes):
    texts = ["abab abba", "", "baé 漢字漢", "abab abba", "zz" * 30, "漢字 ab"]
    target = {0, 3, 5}
    points, bits = trigram_losses(texts)
    counts = [collections.Counter(zip(p, p[1:], p[2:])) for p in points]
    every = sum(counts, collections.Counter())
    chosen = sum((c for i, c in enumerate(counts) if i in target), collections.Counter())
    ratio = sum(chosen.values()) / sum(every.values())

    def models(i):
        """Without what text i itself has added."""
        return (bits({g: float(chosen[g] - (counts[i][g] if i in target else 0)) for g in every}),
                bits({g: (every[g] - counts[i][g]) * ratio for g in every}))

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumns(
        {c: F.lit(1) for c in ("row", "block", "gram", "in_target")}).repartition(2)
    keep = ("doc_id", "row", "block", "in_target")
    rows = lm.score(frame, spark.createDataFrame([(i,) for i in target], "doc_id int"), keep, block_bytes).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and rows[0]["block"] == 1
    for r in rows:
        grams = list(zip(points[r.doc_id], points[r.doc_id][1:], points[r.doc_id][2:]))
        want = [np.mean([m[g] for g in grams]) for m in models(r.doc_id)]
        assert r.n_tokens == len(grams) and np.allclose([r.target_loss, r.background_loss, r.score], [*want, want[0] - want[1]])


def test_texts_of_many_characters_have_losses_of_their_own(spark):
    draw = np.random.default_rng(5)
    han = ["".join(map(chr, draw.integers(0x4E00, 0x4E00 + 3000, 400))) for _ in range(200)]
    rows = list(enumerate([*han, *["the quick brown fox jumps over the lazy dog again " * 4] * 400]))
    got = lm.score(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame([(0,)], "doc_id int"))
    means = {r.han: r.loss for r in got.groupBy((F.col("doc_id") < 200).alias("han")).agg(F.avg("background_loss").alias("loss")).collect()}
    assert means[True] > 8 and means[False] < 1


def check_packing(rows, texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*e.ids, 1] for d, e in zip(texts, t.encode_batch([x or "" for x in texts.values()], add_special_tokens=False), strict=True)}
    at, filled = collections.Counter(), collections.Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {d: len(x) for d, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id]
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and sorted(filled) == list(range(len(filled)))
    return filled, ids


@needs_tables
def test_packing_query(spark, real):
    rows = entries.op9_packing(spark, FOLDER).collect()
    filled, ids = check_packing(rows, {r.doc_id: r.text for r in real})
    assert len(filled) <= sum(map(len, ids.values())) // 2048 + 3
    share = collections.Counter()
    for r in rows:
        share[r.source] += r.length
    total, lead = sum(share.values()), collections.Counter()
    for r in sorted(rows, key=lambda r: r.sequence_id):
        lead[r.source] += r.length
        if r.sequence_id == len(filled) // 2:
            break
    for source, n in share.items():  # no source is more than a window away from its share
        assert abs(lead[source] - n * sum(lead.values()) / total) <= 2048


def test_packing_awkward_rows(spark, docs):
    kept = docs.filter("doc_id is not null and doc_id <> 6")
    check_packing(corpus_pipeline.pack_windows(spark, kept, "").collect(), {r[0]: r[1] for r in AWKWARD if r[0] not in (None, 6)})


def test_special_strings_have_the_ids_of_the_tokenizer(spark, tmp_path):
    texts = {1: "one<|endoftext|>two", 2: "<|endoftext|><|endoftext|> <|endoftext|>\n", 3: "<|endoftext |> <|end", 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("source", F.lit("a")).write.parquet(f"{tmp_path}/documents.parquet")
    _, ids = check_packing(entries.op9_packing(spark, str(tmp_path)).collect(), texts)
    assert ids[1].count(50256) == 1 and ids[2].count(50256) == 3 and 50256 not in ids[3]


def test_quanta_take_turns_like_a_sorted_list():
    quanta = np.array([7, 3, 1, 12])
    order = sorted((((2 * j + 1) / (2 * u), s, j) for s, u in enumerate(quanta) for j in range(u)))
    places = packing.turns(np.array([s for _, s, _ in order]), np.array([j for _, _, j in order]), quanta)
    assert places.tolist() == list(range(len(order)))


@pytest.mark.parametrize("seed", range(8))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
        s = np.append(np.tile(s, rng.integers(1, 4)), 0)
        data = bytes(s.tolist())
        order = induced.suffix_array(s)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
        shared = induced.permuted_lcp(s, order)
        for i, j in zip(order[1:], order[:-1], strict=True):
            assert shared[i] == len(os.path.commonprefix([data[i:], data[j:]]))


def without_repeats(rows):
    seen, out = set(), {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(data[i:i + 100])
        out[doc] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(data, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [5000, 0])
@needs_tables
def test_suffix_dedup(spark, real, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    table = spark.createDataFrame([(r.doc_id, r.text) for r in real], "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(table).collect()}
    assert got == without_repeats([(r.doc_id, r.text) for r in real])


def test_suffix_dedup_with_later_documents_first(spark):
    rng = np.random.default_rng(3)
    passage, other = (" ".join(rng.choice(["ab", "cde", "f", "ghij"], 90)) for _ in range(2))
    rows = [(i, f"{i} {passage} x {other if i % 2 else ''} {i} {passage}"[:400 + 17 * i]) for i in range(12, 0, -1)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(table).collect()}
    assert got == without_repeats(sorted(rows))


def test_stretches_leave_a_task_while_it_reads(spark):
    # Holding the bytes of all stretches of a task took an executor over its memory.
    import pyarrow as pa

    class Table:
        sparkSession = spark

        def mapInArrow(self, work, schema):
            return work

    text = np.random.default_rng(4).integers(97, 123, 5000).astype(np.uint8).tobytes()
    given = []

    def batches():
        for i in range(3):
            given.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([i]), pa.array([text], pa.binary())], ["doc_id", "row_hash", "text"])

    made = suffixes._stretches(Table(), np.full(1 << (bitmaps.FILTER_BITS - 6), -1, np.int64).view(np.uint64))(batches())
    assert next(made).column(5).null_count == 0 and given == [0]
    rest = pa.Table.from_batches(made)
    assert rest.column("stretch").null_count == len(rest) == 2 and rest.column("past").to_pylist() == [5000, 5000]


def test_anchors_spread_over_the_bitmap(spark):
    # By their leading bits a fifth of other anchors met a set bit here; by chance a hundredth does.
    rng = np.random.default_rng(5)
    held, other = (suffixes.anchors(rng.integers(97, 123, size).astype(np.uint8))[2] for size in (400_000, 40_000))
    bits = 20
    old, bitmaps.FILTER_BITS = bitmaps.FILTER_BITS, bits
    try:
        words = bitmaps.bitmap(spark.createDataFrame([(int(g),) for g in held], "gram bigint"))
        assert bitmaps.set_in(words, held).all()
        assert bitmaps.set_in(words, other).mean() < 3 * len(held) / (1 << bits)
    finally:
        bitmaps.FILTER_BITS = old


def test_suffix_dedup_awkward_rows(spark, docs):
    kept = docs.filter("doc_id is not null and doc_id <> 6")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.without_repeats(kept).collect()}
    assert got == without_repeats([(r[0], r[1]) for r in AWKWARD if r[0] not in (None, 6)])
    twice = suffixes.without_repeats(docs.filter("doc_id = 6 or doc_id is null")).collect()
    assert sorted(r.n_removed for r in twice) == [0, 0, 0]


@pytest.mark.parametrize("name", ["simhash", "quality", "toxicity", "shards", "lm", "masked", "deduped"])
def test_awkward_and_empty_tables(spark, docs, name):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, 1, 0), (None, 1, 1), (8, None, None)], "doc_id bigint, quality int, toxic int")
    run = {
        "simhash": lambda d: simhash.near_duplicates(d), "quality": lambda d: quality.judge(d, quality.train(d, labels)),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "shards": lambda d: sharding.shard(d.select("doc_id", "text"), ["doc_id", "text"], 4),
        "lm": lambda d: lm.score(d, labels.select("doc_id")), "masked": lambda d: corpus_pipeline.mask_secrets(spark, d, ""),
        "deduped": lambda d: suffixes.without_repeats(d),
    }[name]
    assert run(docs).count() == len(AWKWARD)
    assert run(docs.limit(0)).count() == 0


def test_texts_without_near_copies_do_not_move(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(3000)])
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    rows = [(i, t, i % 3) for i, t in enumerate([*texts, texts[3], texts[5] + " more"])] + [(7, texts[7], 1), (None, texts[9], 2)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, row int").repartition(3)
    moved, kind = [], type(table)
    plain = kind.dropDuplicates
    monkeypatch.setattr(kind, "dropDuplicates", lambda self, subset=None: (moved.append(self.count() if subset == ["key"] else 0), plain(self, subset))[1])
    kept = corpus_pipeline.drop_near_copies(spark, table, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(60)) and {r.doc_id: r.text for r in kept} == dict(enumerate(texts))
    assert 0 < max(moved) < 10  # all 62 rows before


def test_masking_and_near_copies(spark, docs):
    masked = {r.doc_id: r.text for r in corpus_pipeline.mask_secrets(spark, docs, "").filter("doc_id in (2, 9, 10)").collect()}
    assert masked[10] == "[secret] é password=12" and masked[2] is None and masked[9].startswith("before")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # 9 holds the passage of 1 and 4 between two other words: 55 shingles of 60, above 0.8.
    assert not {4, 9} & set(ids) and {1, 10} <= set(ids)


def test_stages_tell_rows_with_repeated_and_null_ids_apart(spark, tmp_path):
    other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("delta", "omega"))
    rows = [(1, other), (1, other), (1, third), (None, third), (None, LONG), (None, LONG), (2, third), (None, PASSAGE), (3, PASSAGE + " x")]  # the last two hold the item
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, table.filter(~F.col("text").startswith("alpha")), "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, other), (1, third), (None, LONG)], key=str)
    spark.createDataFrame([(1, PASSAGE)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = corpus_pipeline.drop_contaminated(spark, table, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted(rows[:-2], key=str)


def similar_groups(texts):
    """Smallest id of each group of texts linked by shingle sets at 0.8 or more."""
    sets, held = {}, collections.defaultdict(set)
    for d, t in texts.items():
        words = WORD.findall(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[d] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        for s in sets[d]:
            held[s].add(d)
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for d in sorted(texts):
        for o in set().union(*(held[s] for s in sets[d])):
            both = len(sets[d] & sets[o])
            if o > d and 5 * both >= 4 * (len(sets[d]) + len(sets[o]) - both):
                a, b = sorted((top(d), top(o)))
                root[b] = a
    return {d: top(d) for d in texts}


@needs_tables
def test_near_copy_stage_links_all_pairs_from_a_similarity_of_four_fifths(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rng = np.random.default_rng(1)
    base, line = [[f"{k}{i}" for i in range(120)] for k in "bc"], " ".join(f"line{i}" for i in range(30))
    at = max(texts) + 1
    for n in range(200):  # copies with up to eleven edits and a line that many texts share
        words = list(base[n % 2])
        for i in rng.choice(120, n % 12, replace=False):
            words[i] = f"edit{n}x{i}"
        texts[at + n] = " ".join(words)
        texts[at + 1000 + n] = line + " " + " ".join(f"own{n}x{i}" for i in range(int(rng.integers(1, 30))))
    want = similar_groups(texts)
    table = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in texts.items()], SCHEMA).repartition(4)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").select("doc_id").collect())
    missed = set(kept) - set(want.values())
    assert set(want.values()) <= set(kept) and len(missed) <= 0.05 * (len(texts) - len(set(want.values())))


def test_recall_of_bands_at_the_limit(spark):
    """Pairs of unrelated texts with 0.8 to 0.82 in common: bands alone have to find them."""
    rng, texts = np.random.default_rng(8), {}
    for n in range(200):
        words = [f"p{n}w{i}" for i in range(100)]
        texts[2 * n] = " ".join(words)
        for i in rng.choice(12, 2, replace=False):  # two edits, five shingles each, of 96: 86 / 106
            words[int(i) * 8 + 4] = f"edit{i}"
        texts[2 * n + 1] = " ".join(words)
    want = similar_groups(texts)
    assert len(set(want.values())) == 200
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component for r in similar.groups(table).collect()}
    assert np.mean([got[d] == want[d] for d in texts if d % 2]) >= 0.95


@pytest.mark.parametrize("cell", [similar.CELL_ROWS, 16])
def test_links_in_buckets_that_many_groups_share(spark, monkeypatch, cell):
    """A hundred pairs at 0.83 over one template, at 0.75 to one another: no hub of a bucket is like most of its texts."""
    monkeypatch.setattr(similar, "CELL_ROWS", cell)
    template, texts = [f"t{i}" for i in range(204)], {}
    for n in range(100):
        for d in (2 * n, 2 * n + 1):
            texts[d] = " ".join(template + [f"p{n}w{i}" for i in range(12)] + [f"d{d}w{i}" for i in range(21)])
    for d in range(200, 260):  # one large group in the same buckets
        texts[d] = " ".join(template + [f"g{i}" for i in range(33)] + [f"d{d}"])
    want = similar_groups(texts)
    assert len(set(want.values())) == 101
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component for r in similar.groups(table).collect()} == want


def test_unlike_texts_with_a_common_line_make_few_pairs(spark):
    line = " ".join(f"line{i}" for i in range(12))
    rows = [(n, line + " " + " ".join(f"own{n}x{i}" for i in range(40))) for n in range(600)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    prints = similar.marked(table, "doc_id")
    entries = prints.select("name", F.explode("bands").alias("bucket"))
    met = similar._meeting(entries, 0).select("hub", "name").distinct().count()
    assert met < 3 * len(rows) and similar.groups(table).select("component").distinct().count() == len(rows)


def test_stages_with_clashing_columns(spark, tmp_path):
    names = ("kept", "quality", "n_words", "base_failed", "spans", "key", "row", "_key", "masked", "blob", "first", "bad", "raw", "shares")
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, text + " token=abcdef1"), (2, text + " token=abcdef1"), (3, None)], "doc_id bigint, text string").withColumns(
        {n: F.lit(n) for n in names})
    spark.createDataFrame([(1, PASSAGE)], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage_, count in ((corpus_pipeline.keep_good, 2), (corpus_pipeline.drop_near_copies, 2), (corpus_pipeline.drop_contaminated, 3),
                          (corpus_pipeline.mask_secrets, 3)):
        got = stage_(spark, rows, str(tmp_path))
        assert got.columns == rows.columns and got.count() == count
        assert all(r[n] == n for r in got.collect() for n in names)


def test_masking_moves_only_texts_with_a_match(spark, tmp_path):
    rows = [(1, "no match here"), (2, "token=abcdef1 end"), (3, None), (4, "token=abc"), (5, ""), (6, "token=abcdef1 end")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    masked = corpus_pipeline.mask_secrets(spark, spark.read.parquet(str(tmp_path / "docs")), "")
    got = {r.doc_id: (r.text, r.n_chars) for r in masked.collect()}
    texts = {d: t if d not in (2, 6) else "[secret] end" for d, t in rows}
    assert got == {d: (t, None if t is None else len(t)) for d, t in texts.items()}
    # One branch has no join at all: the rows that cannot have spans.
    plan = masked._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and plan.count("Join") == 1


def test_near_copy_stage_leaves_its_result_only(spark, docs):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/codonloom"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    corpus_pipeline.drop_near_copies(spark, docs, "").count()
    assert [n for n in set(os.listdir(folder)) - before if not n.startswith("without_copies")] == []


@needs_tables
def test_pipeline_runs_and_packs_what_it_keeps(spark):
    rows = entries.pipeline(spark, FOLDER).collect()
    kept = {r.doc_id for r in rows}
    quality_kept = {r.doc_id for r in entries.op2_quality_rules(spark, FOLDER).filter("kept").collect()}
    leaked = {r.doc_id for r in entries.op3_decontamination(spark, FOLDER).collect()}
    assert kept and kept <= quality_kept and not kept & leaked
    assert all(f.__name__ in entries.queries() or f.__name__ == "pipeline" for f in entries.queries().values())
