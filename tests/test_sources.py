import bz2
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.sources import files, sinks


@pytest.fixture
def put(tmp_path):
    def put(name, content):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(p)

    return put


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_page_features(spark, put):
    path = put("ab.x+1.pg.tsv", '0\tthe\t3\n0\t"\t1\n-1\t#metaBiography\t1\nbad row\n1\tx\ty\n')
    good, bad = files.page_features(spark, path)
    assert rows(good, "page", "feature") == [("ab.x+1", -1, "#metaBiography", 1), ("ab.x+1", 0, '"', 1), ("ab.x+1", 0, "the", 3)]
    assert bad.count() == 2


@pytest.mark.parametrize("keep,want", [(True, [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (2, 0, "d")]), (False, [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")])])
def test_paged_text(spark, put, keep, want):
    text = "a\nb\n<pb>\nc\n<pb>\nd\n"
    for name, content in (("v.txt", text.encode()), ("v.txt.bz2", bz2.compress(text.encode()))):
        df = files.paged_text(spark, put(name, content), keep_last=keep, suffix=name[1:])
        assert rows(df.select("page", "line", "text"), "page", "line") == want


def test_zipped_volumes(spark, put):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in (("v/p_00000002.txt", "two\nlines"), ("v/p_00000001.txt", "one"), ("v/.DS_Store", "x"), ("v/_notes.txt", "x"), ("v/p_x.txt", "x")):
            z.writestr(name, text)
    put("z/v.zip", b.getvalue())
    df = files.zipped_volumes(spark, put("z/w.zip", b"no zip").rsplit("/", 1)[0])
    assert rows(df, "vol", "page", "line") == [("v", 0, 0, "one", "success"), ("v", 1, 0, "two", "success"), ("v", 1, 1, "lines", "success"), ("w", None, None, None, "missing")]


def test_archived_json(spark, put):
    b = io.BytesIO()
    with tarfile.open(fileobj=b, mode="w:gz") as t:
        for name, text in (("d/a.json", '{"page_categories": {"0": "fic"}, "added_metadata": {"totalpages": 1, "maxcategory": "fic"}}'), ("d/b.json", "{}")):
            info = tarfile.TarInfo(name)
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    df = files.archived_json(spark, put("a.tar.gz", b.getvalue()))
    assert [r.member for r in df.orderBy("member").collect()] == ["d/a.json", "d/b.json"]
    docs = files.volume_documents(spark, df.where("member = 'd/a.json'")).first()
    assert docs.page_categories == {"0": "fic"} and docs.added_metadata.totalpages == 1


def test_extracted_features(spark, put):
    path = put("e/a.json", json.dumps({"id": "a", "features": {"pages": [{"seq": "1", "tokenCount": 5}, {"seq": "2", "tokenCount": 7}]}}))
    put("e/b.json", json.dumps({"id": "b", "features": {}}))
    put("e/c.json", "{broken")
    df = files.extracted_features(spark, path.rsplit("/", 1)[0])
    assert rows(df.where("vol = 'a'"), "page") == [("a", 0, "success", 5), ("a", 1, "success", 7)]
    assert {r.status for r in df.collect()} == {"success", "no pages", "unreadable"}


def test_predictions(spark, put):
    path = put("p.tsv", "v,1,0\tfic\tnon\tbegin::0.0\tend::0.0\tfic::0.7\tnon::0.3\n")
    r = files.prediction_tsv(spark, path).first()
    assert (r.vol, r.page, r.raw, r.smooth, r.probs) == ("v,1", 0, "fic", "non", {"fic": 0.7, "non": 0.3})
    path = put("p.json", "\n".join(json.dumps({"volID": "v", "model": m, "rawPredictions": ["a", "b"], "smoothedPredictions": ["a", m]}) for m in ("one", "ensemble")))
    assert rows(files.prediction_json(spark, path), "page") == [("v", 0, "a", "a"), ("v", 1, "b", "ensemble")]


def test_metadata(spark, put):
    path = put("m.tsv", "id\ttitle\tdate\nv1\tA\nv2\tB\t1900\textra\n")
    assert rows(files.tolerant_metadata(spark, path), "id") == [("v1", "A"), ("v2", "B")]
    assert files.metadata_csv(spark, put("m.csv", "htid,title\nx,Caf\xe9\n".encode("latin-1"))).first().title == "Café"
    xml = '<c><record><leader>00000cam a22</leader><controlfield tag="008">001</controlfield><datafield tag="245"><subfield code="a">T</subfield></datafield></record></c>'
    r = files.marc_records(spark, put("m.xml", xml)).first()
    assert r.controlfield[0]._tag == "008" and r.controlfield[0]._VALUE == "001" and r.datafield[0].subfield[0]._VALUE == "T"


def test_lists_and_rules(spark, put):
    assert rows(files.work_list(spark, put("w.json", '{"w": ["a", "b"]}')), "seq") == [("w", 0, "a"), ("w", 1, "b")]
    assert rows(files.work_list(spark, put("x.json", '["a", "b"]')), "vol") == [("a", 0, "a"), ("b", 0, "b")]
    arff = "% c\n@relation r\n@attribute htid string\nv1,3,5,0,0,0.9\n"
    assert rows(files.range_labels(spark, put("r.arff", arff)), "page") == [("v1", p, 0.9) for p in (3, 4, 5)]
    assert rows(files.vocabulary(spark, put("v.txt", "the\nof\nthe\nx\n"), 3), "idx") == [(0, "the", False), (1, "of", False), (2, "the", True)]
    assert rows(files.rule_table(spark, put("f.txt", "to day\ttoday\r\nA b\tab\r"), ["pair", "fused"]), "pair") == [("A b", "ab"), ("to day", "today")]
    assert rows(files.word_counts_tsv(spark, put("c.tsv", "htid\tpage\tcount\nv\t0\t7\n")), "page") == [("v", 0, 7)]
    assert rows(files.category_maps(spark, put("v.map", "0\tfic\n1\tnon\nbad\n")), "page") == [("v", 0, "fic"), ("v", 1, "non")]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("ab.1", 0, "the", 3), ("ab.1", 0, "#lines", 0), ("ab.1", 0, "#textlines", 0)], "vol string, page int, feature string, count int")
    sinks.features_table(f, str(tmp_path / "f"))
    assert {r.feature for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {"the", "#textlines"}
    t = spark.createDataFrame([("v", 0, 0, i, w) for i, w in enumerate(["“", "Yes"])] + [("v", 0, 1, 0, "No")], "vol string, page int, line int, pos int, token string")
    assert sinks.corrected_text(t).first().text == "“Yes\nNo"
    p = spark.createDataFrame([("v", 0, "a", "b", 0.123450001, 0.5)], "vol string, page int, raw string, smooth string, p_a double, p_b double")
    assert sinks.prediction_lines(p, ["a", "b"]).first().value == "v,0\ta\tb\tbegin::0.0\tend::0.0\ta::0.1235\tb::0.5"
    doc = json.loads(sinks.volume_json(spark.createDataFrame([("v", 0, "fic"), ("v", 1, "non"), ("v", 2, "fic")], "vol string, page int, category string")).first().value)
    assert doc == {"added_metadata": {"totalpages": 3, "maxcategory": "fic", "category_counts": {"fic": 2, "non": 1}}, "page_categories": {"0": "fic", "1": "non", "2": "fic"}}
    sinks.partitioned(spark.createDataFrame([("v", "fic", "1800-49")], "vol string, category string, period string"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.metadata_tsv(spark.createDataFrame([("v", "t")], "id string, title string"), str(tmp_path / "m"))
    assert files.appended_metadata(spark, str(tmp_path / "m")).first().title == "t"
    assert sinks.chunk_lines(spark.createDataFrame([("w", 2, "text")], "work string, chunk int, text string")).first().value == "w|2\tnull\ttext"
