"""The pipeline against the operators' brute-force forms, stage by stage."""

import random
import sys
import zlib
from array import array
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from test_llm_operators import brute_components, brute_line_dedup  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(9)
    stems = {"en": "the of and ing tion was er", "fr": "le de que eau ment ç oi"}
    sentence = lambda lang, n: " ".join("".join(rng.choice(stems[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(n))
    passage = sentence("en", 60)
    rows = []
    for i in range(120):
        lang = ("en", "fr")[i % 3 == 0]
        text = "\n".join(sentence(lang, rng.randint(6, 40)) for _ in range(rng.randint(1, 5)))
        rows.append((i, text + ("\n" + passage if i % 10 == 1 else ""), lang if i % 7 else None, "s", len(text)))
    rows += [(200 + i, rows[i][1].replace(" ", "  ", 1) + " more", "en", "s", 5) for i in range(10)]
    rows += [(300, None, "en", "s", 0), (301, "", "fr", "s", 0), (302, "123 456", "en", "s", 7), (None, sentence("en", 30), "en", None, None)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), [rows]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, str(folder)).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append([tuple(r) for r in docs.collect()])
    return out, str(folder)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "best_fit_packing"]


def test_language_stage_rejects_only_texts_without_letters(stages):
    (before, after, *_), _ = stages
    assert sorted(map(str, after)) == sorted(str(r) for r in before if r[0] not in (300, 301, 302))


def test_line_stage(stages):
    (_, before, after, *_), _ = stages
    want = dict(brute_line_dedup([(r[0], r[1]) for r in before]))
    assert {r[0]: r[1] for r in after} == want and len(after) == len(before)
    assert any(r[1] != dict((x[0], x[1]) for x in before)[r[0]] for r in after)


def test_jaccard_stage(stages):
    (_, _, before, after, _), _ = stages
    groups = brute_components([(r[0], r[1]) for r in before if r[0] is not None])
    want = {r[0] for r in before if r[0] is None or groups[r[0]][1] == r[0]}
    assert {r[0] for r in after} == want and len(after) == len(want)


def test_packing_stage(stages):
    (*_, before, after), _ = stages
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in before:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0] or -1, k, s, len(ids[s : s + 2048]), zlib.crc32(array("I", ids[s : s + 2048]).tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((x[0] or -1, *x[1:5]) for x in after) == sorted(want)
    fill = defaultdict(int)
    for x in after:
        fill[x[5]] += x[3]
    assert max(fill.values()) <= 2048


def test_run_gives_the_last_stage(spark, stages):
    (*_, last), folder = stages
    got = corpus_pipeline.run(spark, folder)
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == sorted(str(x[:5]) for x in last)


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} | {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}


def test_stages_keep_clashing_columns_and_repeated_rows(spark):
    line = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, line + "\nown text of one", "en", "s", 9, "kept", 1.5, 7), (1, line + "\nown text of one", "en", "s", 9, "kept", 1.5, 7), (2, line + "\nother words here", "en", "s", 9, "kept", 2.5, 8), (3, None, "en", "s", 0, "kept", 3.5, 9)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang_pred string, score double, n_dropped int")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:3]):
        out = f(spark, docs, "")
        assert out.columns == docs.columns
        found = sorted(tuple(r) for r in out.collect())
        assert [(r[0], *r[5:]) for r in found] == [(1, "kept", 1.5, 7), (1, "kept", 1.5, 7), (2, "kept", 2.5, 8)]
        docs = spark.createDataFrame(found, docs.schema)
    assert [r[1] for r in found] == [rows[0][1], rows[0][1], "other words here"]
    assert corpus_pipeline.STAGES[3][1](spark, docs, "").count() == 3


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs, "").count() == 0
