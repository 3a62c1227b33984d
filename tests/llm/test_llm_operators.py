import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import byte_bpe, exact_dedup, exact_topk, graph, html_extract, jaccard_join, language_id, line_dedup, packing, shards, token_counts
from leafmill.llm.common import new_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, n_chars long, key string, norm string, size long, text_sha256 string"


def corpus():
    rng = random.Random(3)
    words = ["the", "of", "river", "stone", "ä", "Õ", "don't", "x1", "2024", "long—dash", "naïve", "Straße"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
    texts = [make(rng.randint(6, 60)) for _ in range(60)]
    texts += texts[:5]  # copies
    for t in texts[5:15]:  # near copies
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    base = make(120).split(" ")
    for _ in range(40):  # one group of near copies
        w = list(base)
        w[rng.randrange(len(w))] = f"v{rng.randint(0, 9)}"
        texts.append(" ".join(w))
    shared = make(70)
    texts += [make(20) + "\n" + shared + "\n" + make(15) for _ in range(12)]
    texts += ["", None, " \t\n", "one", "one two three", "One  TWO\tthree", "a b c d e", "a b c d e f", "\n\n", " lead and  trail ", "<|endoftext|> x", "é" * 50, make(4000), "x" * 9000]
    return [(i, t, "en" if i % 3 else None, len(t or ""), "k", None, i, "s") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup(docs, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, bucket_capacity=10).collect()}
    groups = defaultdict(list)
    for r in corpus():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
    assert len(got) == len(corpus()) and len({r.bucket for r in got.values()}) > 4
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    """Keys that share their first 20 bits split far beyond the first directory; every key has one bucket."""
    rng = random.Random(1)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(200)] + [(5 << 44) | rng.randrange(1 << 44) for _ in range(30)]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    buckets = exact_dedup.directory(df, 8)
    found = buckets.collect()
    leading = lambda k, d: (k % (1 << 64)) >> (64 - d)
    for b in found:
        assert b["keys"] == sum(leading(k, b.depth) == b.bits for k in keys) <= 8
    assert sum(b["keys"] for b in found) == len(keys) and max(b.depth for b in found) > 20 > min(b.depth for b in found)
    for r in exact_dedup.routed(df, buckets).collect():
        d, bits = map(int, r.bucket.split(":"))
        assert leading(r.key, d) == bits
    assert [(b.depth, b.bits, b["keys"]) for b in exact_dedup.directory(df, 1000).collect()] == [(0, 0, 230)]
    assert exact_dedup.directory(df.limit(0), 8).count() == 0


def test_dedup_decides_in_buckets(spark):
    """An entry in a wrong bucket is not found: the look-up goes through the directory."""
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(80)], "doc_id long, text string")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"))
    buckets = exact_dedup.directory(rows.select("key").distinct(), 4)
    index = exact_dedup.build_index(docs, buckets, "doc_id", "text")
    assert index.count() == 40 and exact_dedup.look_up(exact_dedup.routed(rows, buckets), index).where("group_size = 2").count() == 80
    wrong = index.withColumn("bucket", F.when(F.col("keep_id") == 7, F.lit("0:0")).otherwise(F.col("bucket")))
    assert {r.doc_id for r in rows.select("doc_id").subtract(exact_dedup.look_up(exact_dedup.routed(rows, buckets), wrong).select("doc_id")).collect()} == {7, 47}


def test_dedup_buckets_have_one_owner_each(spark):
    """All texts of a bucket are decided by one task, from rows that the map tasks have combined; chains compare bytes."""
    docs = spark.createDataFrame([(i, f"text {i % 60}" if i % 3 else "hot") for i in range(900)], "doc_id long, text string").repartition(6)
    keys = docs.select(F.xxhash64("text").alias("key")).distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = exact_dedup.build_index(docs, exact_dedup.directory(keys, 4), "doc_id", "text").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    owners = defaultdict(set)
    for r in index:
        owners[r.bucket].add(r.owner)
    assert len(index) == 41 and len(owners) > 8 and all(len(o) == 1 for o in owners.values()) and len(set().union(*owners.values())) > 1
    assert {(r.keep_id, r.group_size) for r in index if r.group_size == 300} == {(0, 300)}
    one = exact_dedup.build_index(docs.withColumn("text", F.lit("same")), exact_dedup.directory(keys, 1 << 20), "doc_id", "text").collect()
    assert [(r.bucket, r.keep_id, r.group_size) for r in one] == [("0:0", 0, 900)]


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a "), (None, "b"), (3, "b"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows).collect()))
    assert got == [(0, 0, 1, True), (0, 3, 2, False), (1, 1, 2, True), (1, 1, 2, True), (2, 2, 1, True), (3, 3, 2, True)]


def templates_of(rows, depth=3, least=5, similarity=80):
    """The templates of every line of ``(doc_id, text)`` rows: itself, and without its rarest tokens among all lines of its leaf."""
    flat = lambda line: re.sub(r"[ \t\r\f\x0b]+", " ", line).strip(" ")
    masked = lambda line: tuple("<*>" if re.search("[0-9]", w) else w for w in flat(line).split(" "))
    enough = lambda t: sum(x != "<*>" for x in t) >= least and 100 * sum(x != "<*>" for x in t) >= similarity * len(t)
    lines = {line for i, t in rows if i is not None and t is not None for line in t.split("\n") if flat(line)}
    leaves = defaultdict(set)
    for line in lines:
        if enough(masked(line)):
            leaves[len(masked(line)), masked(line)[:depth]].add(masked(line))
    found = {}
    for line in lines:
        m = masked(line)
        if not enough(m):
            found[line] = {flat(line)}
            continue
        leaf = leaves[len(m), m[:depth]]
        rare = sorted((sum(o[k] == t for o in leaf), k) for k, t in enumerate(m) if t != "<*>" and k >= depth)
        found[line], general = {("same", m), ("general", m)}, list(m)
        for _, k in rare:
            general[k] = "<*>"
            if enough(general):
                found[line].add(("general", tuple(general)))
    return found


def brute_line_dedup(rows):
    found, homes = templates_of(rows), defaultdict(set)
    for i, t in rows:
        for line in t.split("\n") if i is not None and t is not None else []:
            for x in found.get(line, ()):
                homes[x].add(i)
    stays = lambda i, x: i is None or all(min(homes[t]) == i for t in found.get(x, ()))
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if stays(i, x))) for i, t in rows]


def dropped_lines(spark, lines):
    """How many of lines, one a document, are dropped."""
    return line_dedup.line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_dropped > 0").count()


def test_line_dedup_fields_whose_values_recur(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(1000 + i))
    line = "your order for customer {} was sent to the town today thanks"
    first = [line.format(name(i)) for i in range(20)]
    again = [line.format(name(i)) + "" for i in range(20)]
    two = "your order for customer {} was sent from {} to the town today with our thanks"
    reused = [two.format(name(i % 20), name(50 + i)) for i in range(40)]
    assert dropped_lines(spark, first) == 19 and dropped_lines(spark, first + again) == 39 and dropped_lines(spark, reused) == 39
    assert dropped_lines(spark, [two.format(name(i), name(50 + j)) for i in range(3) for j in range(3)]) == 8
    # other lines of the leaf, and more of the template, bring nothing back
    prose = ["your order for " + " ".join(name(i * 37 + j * 11) for j in range(8)) for i in range(60)]
    assert dropped_lines(spark, first + prose) == 19 and dropped_lines(spark, first + prose + [line.format(name(i)) for i in range(7, 60)]) == 19 + 53


def line_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(2))
    heads = [" ".join(word() for _ in range(3)) for _ in range(4)]
    bases = [[*rng.choice(heads).split(" "), *[word() for _ in range(rng.randint(2, 20))]] for _ in range(25)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 8)):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice([word(), str(rng.randint(0, 99)), "code" + str(rng.randint(0, 9))])
            lines.append(rng.choice([" ", "  ", " \t"]).join(w))
        rows.append((i, "\n".join(lines)))
    return rows


def test_line_dedup_against_all_lines_of_a_leaf(spark):
    rows = line_rows()
    got = sorted((r.doc_id, r.text) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == sorted(brute_line_dedup(rows))
    assert sum(a != b for a, b in zip(got, sorted(rows), strict=True)) > 50


def test_line_dedup_rows_of_every_kind(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"own line of doc {chr(97 + i)} alone here\n{passage}\nshort one", "x", i) for i in range(8)]
    rows += [(20, None, "x", 0), (21, "", "x", 0), (22, "a\n\nb", "x", 0), (None, passage, "x", 0), (23, "error in unit alpha beta code 17", "x", 0), (24, "error in  unit alpha beta code 99", "x", 0)]
    rows += [(24, "error in  unit alpha beta code 99", "x", 0), (25, "x\nx\nx\n\nshort  one", "x", 0), (26, "x", "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, template long")
    out = line_dedup.line_dedup(df, lines_col="lines_", dropped_col="dropped_").collect()
    got = sorted((str(r.doc_id), str(r.text), r.lines_, r.dropped_) for r in out)
    lines = lambda t: len(t.split("\n")) if t is not None else 0
    want = [(i, t, n) for (i, t), n in zip(brute_line_dedup([r[:2] for r in rows]), [lines(r[1]) for r in rows], strict=True)]
    assert [(g[0], g[1], g[2]) for g in got] == sorted((str(i), str(t), n) for i, t, n in want)
    by_id = {r.doc_id: r for r in out}
    assert (by_id[3].dropped_, by_id[24].dropped_, by_id[0].dropped_, by_id[25].dropped_, by_id[26].dropped_) == (3, 1, 0, 1, 1)
    assert all(r.n_lines == "x" and r.template is not None for r in out)
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_reads_whole_lines(spark):
    """Lines of equal length and beginning whose ends differ are no copies."""
    lead = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, lead + " a b c d e f g h"), (2, lead + " i j k l m n o p"), (3, lead + " a b c d e f g z")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: ""}


def test_line_dedup_of_very_many_lines(spark):
    text = "\n".join(f"line {chr(97 + i % 26)}{i}" for i in range(40_000))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame([(1, text), (2, text + "\nrest")], "doc_id long, text string")).collect()}
    assert got == {1: (text, 40_000, 0), 2: ("rest", 40_001, 40_000)}


def shingle_set(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("star_rounds", [0, 2])
def test_jaccard_components(docs, empty, star_rounds):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, star_rounds=star_rounds).collect()}
    assert got == brute_components([(r[0], r[1]) for r in corpus()])
    assert jaccard_join.jaccard_components(empty).count() == 0


def with_common_shingle(groups=20, seed=5):
    """Texts that all share one passage that is most of them, some within the bound of each other and most not."""
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage, texts = words(40), []
    for _ in range(groups):
        own = words(14)
        for k in range(rng.randint(1, 6)):
            w = passage + own
            if k:
                w = w[: -rng.randint(1, 6)] + words(rng.randint(0, 3))
            texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("star_rounds", [0, 2])
def test_jaccard_one_very_common_passage(spark, monkeypatch, star_rounds):
    """Columns of many chunks, several buckets and blocks: the same components as by brute force."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 8)
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 100)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 4000)
    rows = with_common_shingle()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), star_rounds=star_rounds).collect()}
    want = brute_components(rows)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_cells_product_counts_common_columns():
    import pyarrow as pa

    rng, cells = random.Random(2), defaultdict(list)
    sets = {u: {rng.randrange(12) for _ in range(6)} for u in range(20)}
    for u, own in sets.items():
        for h in own:
            cells[h].append(u)
    rows = [(h, 0, u, len(sets[u]), 0, u, True, bytes(64)) for h, us in cells.items() for u in us]
    names = ["cell", "side", "uid", "n", "alone", "component", "diagonal", "parity"]
    got = jaccard_join._cells_product(1)(pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=names)).to_pylist()
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b]}
    assert {(r["a"], r["b"]): r["overlap"] for r in got} == want


def test_jaccard_repeated_rows_and_null_ids(spark):
    t = "a b c d e f g h i j k l m n o p"
    rows = spark.createDataFrame([(7, t), (7, t), (None, t), (9, t + " q"), (None, "z y x"), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.jaccard_components(rows).collect())
    assert got == [(-1, -1), (-1, 7), (3, 3), (7, 7), (7, 7), (9, 7)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)]
    got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e}


def test_packing(docs, empty, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = packing.pack_documents(docs, path).collect()
    tok = Tokenizer.from_file(path)
    want = []
    for r in corpus():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0], k, s, len(ids[s : s + 2048]), zlib.crc32(array("I", ids[s : s + 2048]).tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed) == sorted(want)
    bins = defaultdict(list)
    for p in packed:
        bins[p.sequence_id].append((p.offset, p.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= packing.lower_bound(np.array([w[3] for w in want]), 2048) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_exchange_meets_in_few_partitions(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.choice([rng.randint(1, 2048), rng.randint(600, 1100)]), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(pieces, part_rows=300).collect()
    assert sorted(p.doc_id for p in packed) == list(range(3000))
    fill = Counter()
    for p in packed:
        fill[p.sequence_id] += p.length
    assert max(fill.values()) <= 2048
    _, _, alone = packing.best_fit_decreasing(np.array([r[3] for r in rows]), 2048)
    assert len(fill) <= len(alone) * 1.01 + 1


def test_lower_bound_never_exceeds_a_packing():
    rng = random.Random(4)
    for _ in range(200):
        lengths = np.array([rng.randint(1, 60) for _ in range(rng.randint(1, 40))])
        _, _, fill = packing.best_fit_decreasing(lengths, 60)
        assert packing.lower_bound(lengths, 60) <= len(fill)
    assert packing.lower_bound(np.array([31] * 10), 60) == 10


def test_byte_bpe_round_trip(docs, empty):
    ranks = byte_bpe.read_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode_documents(encoded, RANKS, step=7).collect()
    both = byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_decoded=True, step=7)
    assert {r.doc_id: r.decoded for r in both.collect()} == {r.doc_id: r.decoded for r in got}
    assert len(got) == len(corpus())
    for r in got:
        ids = library.encode_ordinary(r.text or "")
        assert list(array("I", r.ids)) == ids and r.n_tokens == len(ids) and r.decoded == (r.text or "")
    assert byte_bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_transducer_against_the_library_on_random_text():
    ranks = byte_bpe.read_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    machine, find, rng = byte_bpe.Transducer(ranks), regex.compile(public_tokenizers.PATTERN).findall, random.Random(6)
    letters = "aeéñ ttthion \n\t’'s019.,!中文ие😀ß\x1c "
    for _ in range(800):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        chunks = token_counts.chunks_of(text, find)
        assert "".join(chunks) == text
        assert [i for c in chunks for p in find(c) for i in machine.encode(p.encode())] == library.encode_ordinary(text)
    tokens = list(ranks)[:4000]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        assert machine.valid(a, b) == (byte_bpe.merged(a + b, ranks) == [a, b])


def test_transducer_with_a_small_vocabulary_and_few_states(monkeypatch):
    monkeypatch.setattr(byte_bpe, "STATES", 5)
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"abc": 5, b"cc": 6, b"aa": 7, b"aab": 8}
    machine = byte_bpe.Transducer(ranks)
    for n in range(1, 7):
        for piece in map(bytes, itertools.product(b"abc", repeat=n)):
            want = [ranks[piece]] if piece in ranks else [ranks[t] for t in byte_bpe.merged(piece, ranks)]
            assert machine.encode(piece) == want


def test_streaming_decoder_holds_back_incomplete_characters():
    tokens = {i: bytes([b]) for i, b in enumerate("é😀x".encode())}
    stream = byte_bpe.StreamDecoder(tokens)
    parts = [stream.feed([i]) for i in range(len(tokens))]
    assert parts == ["", "é", "", "", "", "😀", "x"] and stream.end() == ""
    stream.feed([0])
    assert stream.end() == "�"


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in corpus():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(empty, path, public_tokenizers.PATTERN).count() == 0


def test_chunks_end_where_pre_tokens_end():
    split, rng = regex.compile(public_tokenizers.PATTERN).findall, random.Random(11)
    texts = ["".join(rng.choice("ab1.,' \n\t\u00a0\u2003é") for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    texts += ["a   b\tc\td", " a", "a ", "a\nb c", "", " ", "\n", "a\u3000b c", "it's a 'llama"]
    texts += [" ".join(rng.choice(["foo", "b.", "c\nd", "'s", "1,2"]) for _ in range(20)) for _ in range(200)]
    for t in texts:
        chunks = token_counts.chunks_of(t, split)
        assert [p for c in chunks for p in split(c)] == split(t)


@pytest.mark.parametrize("broadcast_bytes", [0, 300, 1 << 20])
def test_token_counts_by_both_parts_of_the_join(spark, broadcast_bytes):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [(r[0], r[1], r[2]) for r in corpus()] + [(1, corpus()[1][1], None), (None, "a b a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(df, path, public_tokenizers.PATTERN, broadcast_bytes=broadcast_bytes).collect())
    assert got == sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)


def test_pre_tokens_are_counted_once(docs, spark):
    from leafmill.llm.common import shipped_file

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    pieces = token_counts.pre_token_counts(docs.select("text"), shipped_file(spark, path), public_tokenizers.PATTERN).collect()
    split = regex.compile(public_tokenizers.PATTERN).findall
    want = Counter(p for r in corpus() if r[1] and "<|endoftext|>" not in r[1] for p in split(r[1]))
    assert {r.piece: r.n for r in pieces} == want and len(pieces) == len(want)
    assert all(r.n_tokens == len(tok.encode(r.piece, add_special_tokens=False).ids) for r in pieces)


def test_language_id(spark, empty):
    rng = random.Random(8)
    stems = {"en": "the of and ing tion was", "fr": "le de que eau ment ç", "de": "der und ung keit sch ü"}
    make = lambda lang: " ".join("".join(rng.choice(stems[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(30))
    rows = [(i, make(lang), lang) for i, lang in enumerate(list(stems) * 60)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34 --", "fr"), (1003, "ungkeitschung", None), (1004, "x" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language_id.fit(df.where(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:180])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert df.select(language_id.held_out(F.col("doc_id")).alias("h"), "doc_id").where("h").collect()[0].doc_id in [i for i in range(2000) if zlib.crc32(str(i).encode()) % 4 == 2]
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_language_scores_against_plain_python(docs):
    rng = random.Random(6)
    sample = [(r[0], r[1], ("en", "de", "fr")[r[0] % 3]) for r in corpus() if r[1]]
    model = language_id.fit(docs.where("text <> ''").withColumn("lang", F.expr("element_at(array('en', 'de', 'fr'), cast(doc_id % 3 as int) + 1)")))
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for _, t, lang in sample:
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", t.lower()):
            words[w][lang] += 1
            for n in range(1, 6):
                for i in range(len(w) + 3 - n):
                    grams[n, f" {w} "[i : i + n]][lang] += 1
    words = {w: c for w, c in words.items() if sum(c.values()) >= 2}
    grams = {g: c for g, c in grams.items() if sum(c.values()) >= 2}
    langs = ["de", "en", "fr"]
    total = lambda rows: {x: sum(c[x] + 0.5 for c in rows) for x in langs}
    of_words, of_grams = total(words.values()), {n: total([c for (m, _), c in grams.items() if m == n]) for n in range(1, 6)}

    def scores(text):
        out = dict.fromkeys(langs, 0.0)
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            if w in words:
                own = {x: np.log((words[w][x] + 0.5) / of_words[x]) for x in langs}
            else:
                own = dict.fromkeys(langs, 0.0)
                for n in range(5, 0, -1):
                    known = [grams[n, g] for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)) if (n, g) in grams]
                    if known:
                        own = {x: float(np.mean([np.log((c[x] + 0.5) / of_grams[n][x]) for c in known])) for x in langs}
                        break
            out = {x: out[x] + own[x] for x in langs}
        return out

    scorer = language_id.Scorer(model)
    texts = [t for _, t, _ in sample] + ["river riverstone ston", "ÄÖÜ naï", "".join(rng.choice("abcdeé ") for _ in range(300))]
    for t in texts:
        want = scores(t)
        lang, score = scorer.predict(t)
        if not regex.search(r"\p{L}", t):
            assert (lang, score) == ("und", 0.0)
            continue
        top = max(want.values())
        p = {x: np.exp(v - top) for x, v in want.items()}
        assert want[lang] == pytest.approx(top, abs=1e-3) and score == pytest.approx(p[lang] / sum(p.values()), abs=1e-3)
        scorer.trim(5)


def test_language_of_letters_with_numerals_and_clashing_columns(spark):
    rows = [(1, "the the the"), (2, "x²"), (3, "the²"), (4, "½ 12 _"), (4, "½ 12 _"), (5, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("score", F.lit("own"))
    got = language_id.identify(df, language_id.fit(df), pred_col="p_", score_col="s_").collect()
    assert sorted((r.doc_id, r.p_) for r in got) == [(1, "en"), (2, "en"), (3, "en"), (4, "und"), (4, "und"), (5, "en")]
    assert all(r.score == "own" and r.lang == "en" for r in got)


def brute_topk(rows, queries, k):
    ints = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            ints[i] = [int(np.floor(256 * float(x))) for x in v]
    out = []
    for q in queries:
        if q in ints:
            scores = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_exact_topk(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * 0.3 + rng.normal(size=8) * 0.1).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(900)]  # ties
    rows += [(5000, None), (5001, []), (5002, [None] * 8), (5003, [float("nan")] * 8), (5004, [float("inf")] + [0.0] * 7), (5005, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumn("score", F.lit("clash"))
    queries = df.where((F.col("vec_id") % 50 == 0) | (F.col("vec_id") > 4999))
    got = sorted(tuple(r) for r in exact_topk.exact_topk(queries, df, steps=(2, 4)).collect())
    assert got == brute_topk(rows, [i for i, _ in rows if i % 50 == 0 or i > 4999], 5)
    few = df.where("vec_id < 3")
    assert exact_topk.exact_topk(few, few).count() == 6
    assert exact_topk.exact_topk(df.limit(0), df).count() == 0
    assert exact_topk.exact_topk(df, df.limit(0)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy</div><div class="top-box"><p>Same on all pages</p></div>
<article><h1>Title {n}</h1><p>First &amp; <b>bold  {n}<br>after<p>Second&nbsp;para {n}</p><div class="comments"><p>reader says</p></div></article>
<div class="plain"><p>Extra {n}</p></div><form><input><p>Name</p></form><footer>&copy; host</footer></body></html>"""


def test_html_extract(spark):
    rows = [(i, "http://h.example.com/x", PAGE.format(n=i)) for i in range(12)]
    rows += [(100, None, None), (101, "bad url", ""), (102, "http://one.example.com", "<p>a<p>b &lt;c&gt;<ul><li>d<li>e</ul>tail"), (103, "http://one.example.com", "plain  text\n only"), (104, "http://one.example.com", "<div><p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("noise", F.lit(1))
    for rows_limit in (1000, 0):
        got = {r.page_id: r for r in html_extract.extract_text(df, broadcast_rows=rows_limit).collect()}
        for i in range(12):
            assert got[i].text == f"Title {i}\nFirst & bold {i} after\nSecond para {i}\nExtra {i}"
            assert got[i].n_chars == len(got[i].text)
        assert [got[i].text for i in (100, 101, 102, 103, 104)] == ["", "", "a\nb <c>\nd\ne\ntail", "plain text only", ""]
    assert html_extract.extract_text(df.limit(0)).count() == 0


def brute_importance(pages):
    """Content importance of ``(host, path)`` from ``(host, html, [(path, text), ...])`` rows, by the definition."""
    contents, hosts = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for host, html, blocks in pages:
        hosts[host].add(html)
        for path, text in blocks:
            contents[host, path][text].add(html)
    out = {}
    for (host, path), texts in contents.items():
        counts = [len(x) for x in texts.values()]
        entropy = [np.log(c) / np.log(len(hosts[host]) + 8) for c in counts]
        out[host, path] = 1 - sum(c * e for c, e in zip(counts, entropy, strict=True)) / sum(counts)
    return out


def style_pages():
    """Pages with boilerplate inside articles and plain divs: what tells is how often texts recur on the host."""
    rng, rows = random.Random(12), []
    places = {"/div.a/p": 1, "/div.b/p": 3, "/article/p": 400, "/article/section/p": 2, "/article/div.c/p": 40}
    for i in range(90):
        host = f"h{i % 3}.example.com" if i < 80 else "few.example.com"
        blocks = [(path, f"{path[1:2]}{rng.randrange(n)} of {host}") for path, n in places.items() for _ in range(rng.randint(1, 2))]
        html = "<html><body>"
        for path, text in blocks:
            steps = [x.split(".") for x in path[1:].split("/")]
            html += "".join(f"<{t}{' class=' + c[0] if c else ''}>" for t, *c in steps) + text + "".join(f"</{t}>" for t, *_ in reversed(steps))
        rows.append((host, html, blocks))
    return rows + rows[:7]  # copies count once


def test_style_tree_and_text_by_brute_force(spark):
    rows = style_pages()
    df = spark.createDataFrame([(i, f"http://{h}/x", html) for i, (h, html, _) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    want = brute_importance(rows)
    got = {(r.host, r.path): r.importance for r in html_extract.style_tree(df).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    texts = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    for i, (host, _, blocks) in enumerate(rows):
        assert texts[i] == "\n".join(t for p, t in blocks if want[host, p] * (1 if "article" in p else 0.5) >= 0.3)
    dropped = {p for h, p in want if h == "h0.example.com" and want[h, p] * (1 if "article" in p else 0.5) < 0.3}
    assert dropped == {"/div.a/p", "/div.b/p", "/article/section/p"}


def test_style_tree_importance(spark):
    df = spark.createDataFrame([(i, "http://h.example.com/x", PAGE.format(n=i)) for i in range(12)], "page_id long, url string, html string")
    found = {r.path: r.importance for r in html_extract.style_tree(df).collect()}
    assert found["/div.top-box/p"] < 0.2 and found["/div.plain/p"] > 0.9 and found["/article/h1"] == pytest.approx(1)


def test_page_tree_takes_linear_time():
    import time

    start = time.process_time()
    for opening in ("<div>", "<p>", "<li>", "<p><article>", "<ul><li>", "<td>", "<form>", "</div>", "<div></p>"):
        page = html_extract.PageTree.of(opening * 100_000 + "x")
        assert [b[2] for b in page.blocks] == ["x"]
    assert time.process_time() - start < 60


def test_items_end_items_of_their_own_list():
    page = html_extract.PageTree.of("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul><p>f<div>g</div><table><tr><td>h<td>i<tr><td>j</table>")
    assert [b[2] for b in page.blocks] == list("abcdefghij")
    paths = ["/".join(b[1]) for b in page.blocks]
    assert paths[:5] == ["/ul/li", "/ul/li/ul/li", "/ul/li/ul/li", "/ul/li", "/ul/li"] and paths[5:7] == ["/p", "/div"] and paths[7] == paths[8] == paths[9] == "/table/tr/td"


def test_shard_store(spark, docs):
    store = shards.ShardStore(spark, new_path(spark, "store"), target_bytes=40_000, fanout=3)
    assert store.manifest() == shards.Version(0)
    versions = store.append_all(docs.withColumn("arrival", F.col("doc_id") % 9), "arrival")
    assert versions == list(range(1, 10))
    before, many = store.manifest().number, store.shards()
    assert store.compact() > 0
    version, few = store.manifest().number, store.shards()
    assert version > before and len(few) < len(many) and sum(s.rows for s in few) == docs.count()
    tiers = Counter(store.tier(s) for s in few)
    assert all(n < 3 for t, n in tiers.items() if t >= 0) and not store.full_tiers()
    assert sorted(r.doc_id for r in store.read(before).collect()) == sorted(r.doc_id for r in store.read().collect()) == [r[0] for r in corpus()]
    assert store.read(3).count() < docs.count()
    with pytest.raises(shards.CommitConflict):
        store.commit(shards.Version(version))
    assert store.vacuum() > 0 and store.versions() == [version]
    assert store.read().exceptAll(docs).count() == 0


def test_shard_store_conflicts_and_orphans(spark, monkeypatch):
    """A writer that comes second commits to the next version; one whose shards are gone leaves nothing behind."""
    root = new_path(spark, "store")
    rows = spark.createDataFrame([(i, f"t{i}", "own") for i in range(40)], "id long, text string, shard string").repartition(2)
    one, two = (shards.ShardStore(spark, root, target_bytes=1 << 20, fanout=4) for _ in range(2))
    for _ in range(3):
        one.append(rows)
    commit, raced = shards.ShardStore.commit, []

    def late(store, version):
        if store is one and not raced:
            raced.append(version.number)
            two.append(rows)
        return commit(store, version)

    monkeypatch.setattr(shards.ShardStore, "commit", late)
    assert one.append(rows) == 5 and raced == [4] and one.read().count() == 200
    monkeypatch.setattr(shards.ShardStore, "commit", lambda store, version: (store is one and not raced.append(0) and len(raced) == 2 and two.compact(), commit(store, version))[1])
    assert not one.compact_once()
    listed = {s.path.rsplit("/", 1)[0] for v in one.versions() for s in one.shards(v)}
    assert {f"data/{n}" for n, _, _ in one._names("data")} == listed  # what the second compaction wrote is gone
    monkeypatch.undo()
    rows.write.parquet(f"{root}/data/run-lost")  # a writer that was lost before it committed
    assert one.vacuum() > 0 and any(n.endswith(".parquet") for n, _, _ in one._names("data/run-lost"))
    assert one.vacuum(min_age=0) == 2 and one.read(shard_col="at").count() == 200
    assert {r.shard for r in one.read().collect()} == {"own"}


def test_shard_store_segments(spark, monkeypatch):
    monkeypatch.setattr(shards, "SEGMENT", 3)
    store = shards.ShardStore(spark, new_path(spark, "store"), target_bytes=1)
    rows = spark.createDataFrame([(1, None), (1, None), (None, "x" * 100_000)], "id long, text string").coalesce(1)
    for _ in range(7):
        store.append(rows)
    last = store.manifest()
    assert len(last.segments) == 2 and len(last.shards) == 1 and len(store.shards()) == 7
    assert store.read().count() == 21 and store.read(4).count() == 12
    store.vacuum(min_age=0)
    assert store.read().exceptAll(rows).count() == 18 and store.compact() == 0


def test_shard_store_without_rows(spark, empty):
    store = shards.ShardStore(spark, new_path(spark, "store"))
    assert store.append_all(empty.withColumn("arrival", F.lit(1)), "arrival") == [] and store.append(empty) is None
    assert store.compact() == 0 and store.read().count() == 0


def test_exact_topk_keeps_large_components_and_every_dimension(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, (rng.normal(size=8) * 10.0 ** rng.integers(3, 6)).tolist()) for i in range(60)]  # beyond 4096
    rows += [(400 + i, [float(rng.integers(-(1 << 20), 1 << 20)), 1e6 + i, *[0.5] * 6]) for i in range(5)]  # scores beyond 2**53
    rows += [(420, [0.0] * 8), (450, [1e30] + [0.0] * 7)]
    other = [(500 + i, rng.normal(size=3).tolist()) for i in range(120)] + [(700, [0.0, 5e5, 0.0])]
    schema = "vec_id long, embedding array<double>"
    small = [r for r in rows if r[0] != 450]
    df = spark.createDataFrame(small + other, schema).repartition(3)
    queries = df.where("vec_id % 10 = 0 OR vec_id BETWEEN 400 AND 405")
    got = sorted(tuple(r) for r in exact_topk.exact_topk(queries, df, steps=(2, 4)).collect())
    asked = [i for i, _ in small + other if i % 10 == 0 or 400 <= i <= 405]
    assert got == sorted(brute_topk(small, asked, 5) + brute_topk(other, asked, 5))
    assert any(abs(r[3]) > 1 << 53 for r in got)
    zeros = spark.createDataFrame([(420, [0.0] * 8), (450, [1e30] + [0.0] * 7), (451, [0.0, 1.0] + [0.0] * 6)], schema)
    assert sorted(tuple(r) for r in exact_topk.exact_topk(zeros, zeros).collect()) == [(420, 1, 450, 0), (420, 2, 451, 0), (450, 1, 420, 0), (450, 2, 451, 0), (451, 1, 420, 0), (451, 2, 450, 0)]


NAMED_PAGE = """<div class="layout with-sidebar"><form><article class="post-navigation"><p>Main {n}</p><div class="elementor-widget elementor-widget-text-editor"><p>Text {n}</p></div><div class="comments"><p>same</p></div></article></form>
<div class="page has-navigation"><p>Body {n}</p></div><div class="sidebar"><p>links</p></div><nav><article>menu {n}</article></nav></div>"""


def test_html_extract_class_names(spark):
    """A class that is such a name tells; one that has it as a part must be confirmed; an article ends what is around it."""
    rows = [(i, "http://h.example.com/x", NAMED_PAGE.format(n=i)) for i in range(12)] + [(50, "http://few.example.com", NAMED_PAGE.format(n=50))]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Main {i}\nText {i}" for i in [*range(12), 50])
    plain = "<div class='market-share'><p>Share {n}</p></div><div class='social-history'><p>History {n}</p></div><div class='page has-navigation'><p>Body {n}</p><div class='related-items'><p>Same</p></div></div><div class='comments'>Says {n}</div>"
    rows = [(i, "http://h.example.com/x", plain.format(n=i)) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Share {i}\nHistory {i}\nBody {i}" for i in range(12))


def extracted(spark, pages, host="h"):
    rows = [(i, f"http://{host}.example.com/{i}", html) for i, html in enumerate(pages)]
    found = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


@pytest.mark.parametrize("copies", [1, 2, 6, 8, 20])
def test_an_article_on_many_pages_of_a_host_stays(spark, copies):
    rng = random.Random(3)
    body = [" ".join(f"word{rng.randint(0, 300)}" for _ in range(60)) for _ in range(8)]
    pages = [f"<article><h1>Title</h1>{''.join(f'<p>{b}</p>' for b in body)}<p>session {i}</p></article>" for i in range(copies)]
    assert extracted(spark, pages) == ["\n".join(["Title", *body, f"session {i}"]) for i in range(copies)]


@pytest.mark.parametrize("n", [1, 5, 12])
def test_prose_in_classes_that_sound_like_boilerplate_stays(spark, n):
    say = lambda what, i: f"this {what} number {chr(97 + i)} tells at some length what happened in the town"
    page = "<article><p>{}</p><div class='notice'><p>{}</p></div><section class='social history'><p>{}</p></section><div id='share'><p>{}</p></div><div class='share'><a href='/x'>Share this</a></div><div class='comments'><p>{}</p></div></article><div class='ad'>Buy {}</div>"
    got = extracted(spark, [page.format(*[say(w, i) for w in ("text", "notice", "history", "share", "remark", "offer")]) for i in range(n)])
    assert got == ["\n".join(say(w, i) for w in ("text", "notice", "history", "share")) for i in range(n)]


def test_the_tree_decides_about_names(spark):
    """The same names: kept where their contents vary over the host's pages, removed where they recur."""
    page = "<div class='notice'><p>{}</p></div><div class='text'><p>Own text of page {} with more than ten words so that the page stands for it</p></div>"
    vary, same = ([page.format(f"notice {chr(97 + i)}" if v else "the same notice", chr(97 + i)) for i in range(12)] for v in (True, False))
    assert all(t.startswith("notice") for t in extracted(spark, vary)) and not any("notice" in t for t in extracted(spark, same))
    assert not any("notice" in t for t in extracted(spark, vary[:3]))  # three pages confirm nothing


def test_style_tree_removes_menus_of_many_items(spark):
    menu = "".join(f"<li>item {chr(97 + i)}</li>" for i in range(20))
    page = "<div class='top'><ul>" + menu + "</ul></div><div class='text'><p>Own {n}</p><p>More {n}</p></div>"
    rows = [(i, "http://h.example.com/x", page.format(n=i)) for i in range(12)] + [(100 + i, "http://few.example.com/x", page.format(n=i)) for i in range(2)]
    df = spark.createDataFrame(rows + [(200, "http://few.example.com/y", rows[-1][2])], "page_id long, url string, html string")
    nodes = {(r.host, r.path): (r.pages, r.importance) for r in html_extract.style_tree(df).collect()}
    assert nodes["h.example.com", "/div.top/ul/li"] == (12, pytest.approx(1 - np.log(12) / np.log(20))) and nodes["h.example.com", "/div.text/p"] == (12, pytest.approx(1))
    assert nodes["few.example.com", "/div.text/p"][0] == 2  # the third page is a copy
    got = {r.page_id: r.text for r in html_extract.extract_text(df).collect()}
    assert all(got[i] == f"Own {i}\nMore {i}" for i in range(12))
    assert all("item a" in got[100 + i] for i in range(2))  # two pages tell little


def test_line_dedup_short_lines(spark):
    rows = [(1, "Share this\n\n1 2 3 4 5 6 7\n你好世界\nalone"), (2, "Share  this\n\n1 2 3 4 5 6 8\n你好世界"), (3, "share this\n\n1 2 3 4 5 6 7"), (None, "Share this")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.line_dedup(df).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\n1 2 3 4 5 6 8", 2), 3: ("share this\n", 1), None: ("Share this", 0)}


def test_shard_store_refuses_other_columns_and_reopens(spark):
    root = new_path(spark, "store")
    store = shards.ShardStore(spark, root)
    rows = lambda names, *r: spark.createDataFrame(list(r), names)
    with pytest.raises(shards.SchemaMismatch):
        store.read()
    store.append(rows("doc_id long, text string", (1, "a")))
    with pytest.raises(shards.SchemaMismatch):
        store.append(rows("doc_id long, other string, text2 string", (2, "b", "c")))
    with pytest.raises(shards.SchemaMismatch):
        store.append(rows("doc_id string, text string", ("2", "b")))
    with pytest.raises(shards.SchemaMismatch):
        store.append_all(rows("doc_id long, arrival int", (2, 1)), "arrival")
    again = shards.ShardStore(spark, root)
    again.append(rows("text string, doc_id long", ("b", 2), (None, None), ("b", 2)))
    again.append_all(rows("doc_id long, arrival int, text string", (3, 1, "c"), (4, None, "d")), "arrival")
    assert again.read().columns == ["doc_id", "text"]
    assert sorted(tuple(r) for r in shards.ShardStore(spark, root).read().collect() if r.doc_id) == [(1, "a"), (2, "b"), (2, "b"), (3, "c"), (4, "d")]
    assert shards.ShardStore(spark, new_path(spark, "store"), schema="a int").read().count() == 0


def test_words_and_marks_of_packing_have_the_ids_of_the_library(monkeypatch):
    odd = ["<|ENDOFTEXT|> a", "a<|endoftext|>b", "x's don't a.'s 'll S a'.b", "\u00e9.e\u0301,x", "1.5,2 a1.b2_c__d", "\u00d7.\u00f7,a\u00d7", "\u0391\u03a3:\u0392 \u0391\u03a3.", "\u0130.x I", "a\u2260b =\u0338", "a--b...c,,d$$$", "\u00b2a.\u00b3", "\u0178,\u0178A.", "", " *3,"]
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        content = f.read()
    monkeypatch.setattr(packing, "WORDS", 8)
    encode, whole = packing.chunk_encoder("odd words", content), Tokenizer.from_str(content.decode())
    want = [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in odd]
    assert [encode([t])[0] for t in odd * 2] == want * 2 and encode(odd) == want
    kept = [v for cell in encode.__closure__ if isinstance(v := cell.cell_contents, dict)]
    assert {"a", "--b", "$$$"} <= kept[0].keys() | kept[1].keys()


def test_texts_without_spaces_are_not_kept(spark):
    rng = random.Random(2)
    texts = ["".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(2000)) + "\n" + "x" * 100 for _ in range(40)]
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        content = f.read()
    encode = packing.chunk_encoder("long texts", content)
    whole = Tokenizer.from_str(content.decode())
    assert encode(texts) == [array("I", whole.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    kept = [v for cell in encode.__closure__ if isinstance(v := cell.cell_contents, dict)]
    assert len(kept) == 2 and all(len(k) <= packing.LONG for d in kept for k in d)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "a short one", *texts[:3]])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, path, public_tokenizers.PATTERN).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate([*texts, "a short one", *texts[:3]])}
