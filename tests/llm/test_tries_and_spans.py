"""The prefix trie, the Merkle manifest and substring dedup against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from leafmill.llm import merkle, prefix_trie, queries, substring_dedup

# --- prefix trie ---------------------------------------------------------------------------------


def trie_model(convs):
    """Nodes of {conv_id: [(role, text), ...]} by walking every prefix."""
    members, ends = defaultdict(set), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].add(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)

    def below(p):
        return [p, *[q for k in kids[p] for q in below(k)]]

    rows = []
    for p, m in members.items():
        sub = below(p)
        saved = sum((len(members[q]) - 1) * (len(q[-1][1].encode()) if q else 0) for q in sub)
        ids = ",".join(map(str, sorted(ends[p])))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in sub), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(rows, key=str)


def trie_rows(spark, convs, **sizes):
    key = lambda r, t: hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest()
    turns = spark.createDataFrame([(c, i, key(r, t), len(t.encode())) for c, ts in convs.items() for i, (r, t) in enumerate(ts)], "conv_id long, position long, turn binary, n_bytes long")
    nodes, ends = prefix_trie.prefix_trie(turns, spark.createDataFrame([(c,) for c in convs], "conv_id long"), **sizes)
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(parents, "parent", "left").join(prefix_trie.end_digests(ends), "node", "left")
    none = hashlib.sha256(b"").hexdigest()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, r.ends_sha256 or none) for r in found.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"shard": 3, "block": 2}, {"shard": 7, "block": 5}])
def test_prefix_trie(spark, sizes):
    rng = random.Random(5)
    convs = {}
    for c in rng.sample(range(-20, 400), 60):
        convs[c] = [(rng.choice(["user", "bot"]), rng.choice(["", "a", "bé", "a long answer"])) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9]))]
    for c in range(1000, 1020):  # copies, and prefixes of each other
        convs[c] = [("user", "same")] * (c % 7)
    convs[5000] = [("user", str(i % 3)) for i in range(40)]
    convs[5001] = convs[5000][:33] + [("bot", "other")]
    assert trie_rows(spark, convs, **sizes) == trie_model(convs)


def test_rebuilt_conversations(spark):
    rng = random.Random(7)
    rows = [(c, rng.choice([None, 1, 2, 3, 3]), rng.choice([None, "user", "bot"]), rng.choice([None, "", "x", "yy", "ß"]), "z") for c in [None, 0, 1, 2, 4, 7, 10, 11, 13, 14, 99] for _ in range(rng.randint(1, 12))]
    rows += [(20, 1, "user", "x", "z")] * 5
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    own = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t for _, _, t in sorted(ts)] for c, ts in own.items()}
    want = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        want[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    turns, convs = queries.rebuilt_conversations(prefix_trie.ordered_turns(df))
    got = {r.conv_id: [] for r in convs.collect()}
    for r in turns.orderBy("conv_id", "position").collect():
        assert r.position == len(got[r.conv_id])
        got[r.conv_id].append(bytes(r.turn))
    key = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    assert {c: [hashlib.md5(f"{len(r.encode())}:{r}{t}".encode()).digest() for r, t in ts] for c, ts in want.items()} == got
    assert key("a", "b") != key("", "ab")


def test_no_conversations(spark):
    empty = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    turns, convs = queries.rebuilt_conversations(prefix_trie.ordered_turns(empty))
    nodes, ends = prefix_trie.prefix_trie(turns, convs)
    assert nodes.count() == 0 and ends.count() == 0


# --- Merkle manifest -----------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_model(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def grow(nodes):
    """The root of one tree, and for each leaf the siblings and its place in the run, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for leaf, p in enumerate(at):
            run = runs[p // 16]
            paths[leaf].append((run[: p % 16], run[p % 16 + 1 :]))
            at[leaf] = p // 16
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def manifest_model(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_model(r, r["text"]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: (sorted(by[s], key=lambda x: x[:3]), *grow([x[2] for x in sorted(by[s], key=lambda x: x[:3])])) for s in sources}
    root, tops = grow([own[s][1] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        leaves, subroot, paths = own[s]
        for (_, _, leaf, r), path in zip(leaves, paths, strict=True):
            fold = leaf
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                fold = leaf_model(r, re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
            for left, right in path + top:
                fold = sha("".join([*left, fold, *right]))
            out.append((r["doc_id"], leaf, subroot, root, sha("".join(x for left, right in path + top for x in left + right)), fold, fold == root))
    return sorted(out, key=str)


def manifest_rows(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"], "x", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, place int")
    found = merkle.manifest(df.repartition(5), F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def doc_rows(n, source, rng, first=0):
    texts = ["Plain Text", "lower only", "", None, "Éa Ä", "x" * 3000]
    return [{"doc_id": first + i, "source": source(i), "lang": rng.choice(["en", None]), "n_chars": rng.choice([None, 5]), "text": rng.choice(texts)} for i in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 16, "c": 17, None: 3, "": 2, "é": 300, "Z": 33}, {"hot": 4099, "b": 1}, {"one": 1}])
def test_merkle_manifest(spark, sizes):
    rng = random.Random(3)
    rows = [r for k, (s, n) in enumerate(sizes.items()) for r in doc_rows(n, lambda _, s=s: s, rng, 10_000 * k)]
    rows += [dict(rows[0], doc_id=None), dict(rows[0]), dict(rows[0], text="Other")]  # no id, a repeated row, a repeated id
    assert manifest_rows(spark, rows) == manifest_model(rows)


def test_merkle_many_sources(spark):
    rows = doc_rows(4100, lambda i: f"s{i}", random.Random(4))
    assert manifest_rows(spark, rows) == manifest_model(rows)


def test_merkle_empty(spark):
    assert manifest_rows(spark, []) == []


# --- substring dedup -----------------------------------------------------------------------------


def spans_model(rows, window=20):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < (d, i):
                    gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str), words


def span_texts():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)] + ["naïve", "über-lang-und-länger", "x" * 17, "12345678", "123456789", " "]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [make(rng.choice([19, 20, 21, 60, 200])) for _ in range(6)]
    texts = [make(rng.randint(0, 30)) + " " + rng.choice(shared) + "\n" + rng.choice(shared) + "\t" + make(rng.randint(0, 30)) for _ in range(40)]
    base = make(150).split(" ")
    for _ in range(25):  # near copies: factors with edits between them
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 3)}"
        texts.append(" ".join(w))
    texts += ["same " * 45, "same " * 30, "a b " * 40, None, "", " \n", make(19), make(20), make(5000), texts[3], texts[3]]
    return texts


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_BYTES": 900, "BUCKET_BYTES": 2000}, {"BLOCK_BYTES": 900, "BUCKET_BYTES": 1000, "MOST_PACKS": 5}])
def test_substring_dedup(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(substring_dedup, name, value)
    texts = span_texts()
    rows = [(i if i % 13 else 13 * (i // 26), t) for i, t in enumerate(texts)]  # some rows repeat an id
    rows += [(None, texts[0]), (-5, texts[1]), (10_000_000_000, texts[1])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, start int, marks string")
    found = substring_dedup.substring_dedup(df.repartition(4)).collect()
    want, words = spans_model(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=str) == want
    at = defaultdict(list)
    for (d, _), w in zip(rows, words, strict=True):
        at[d].append(w)
    for r in found:  # every factor says where its words stand first
        for f in r.factors:
            assert f.words >= 20
            own = [w[f.start : f.start + f.words] for w in at[r.doc_id]]
            assert any(w[f.source_start : f.source_start + f.words] in own for w in at[f.source_doc])
            assert (f.source_doc, f.source_start) < (r.doc_id, f.start)


def test_substring_dedup_empty(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_follow_the_bytes():
    import numpy as np

    words = ["a", "b", "ab", "12345678", "123456789", "1234567812345678", "é" * 9, "x" * 100, "a"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    h = substring_dedup.word_hashes(data, *substring_dedup.word_bounds(data))
    assert len(set(h.tolist())) == len(words) - 1 and h[0] == h[-1]
