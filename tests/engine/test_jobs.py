import hashlib
import json

import pytest

from paragraf import jobs
from paragraf.sources import shards


def test_shards(spark, tmp_path):
    rows = [(k, f"ü text {k % 7}" * (k % 9), None if k % 5 == 0 else k / 3) for k in range(300)] + [(1, "same", 0.5)] * 4
    df = spark.createDataFrame(rows, "id long, `a text` string, x double")
    shape = "id long, `a text` string, x double"
    for kind in ("json", "parquet"):
        path = str(tmp_path / kind)
        made = shards.write_shards(df, path, 2000, kind).collect()
        assert sum(r.rows for r in made) == len(rows) and len(made) > 5 and len({r.shard for r in made}) == len(made)
        for r in made:
            content = (tmp_path / kind / "data" / r.file).read_bytes()
            assert (r.bytes, r.sha256) == (len(content), hashlib.sha256(content).hexdigest())
        if kind == "json":
            assert max(r.bytes for r in made) < 2000 + 400
            assert [json.loads(x)["id"] for x in (tmp_path / kind / "data" / made[0].file).read_text().splitlines()]
        assert sorted(map(tuple, shards.read_shards(spark, path, shape, kind).collect()), key=repr) == sorted(rows, key=repr)
    again = shards.write_shards(df.repartition(3), str(tmp_path / "again"), 2000).collect()
    first = spark.read.schema(shards.MANIFEST).json(str(tmp_path / "json" / "manifest")).collect()
    assert sorted(r.sha256 for r in again) == sorted(r.sha256 for r in first)
    victim = next((tmp_path / "json" / "data").rglob("*.json"))
    victim.write_text(victim.read_text() + "{}\n")
    for crc in victim.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(shards.BrokenShards):
        shards.read_shards(spark, str(tmp_path / "json"), shape)
    assert shards.write_shards(df.limit(0), str(tmp_path / "none")).count() == 0
    assert shards.read_shards(spark, str(tmp_path / "none"), shape).count() == 0
    with pytest.raises(ValueError):
        shards.write_shards(df, str(tmp_path / "x"), kind="csv")


def test_index_job(spark, tmp_path):
    (tmp_path / "a.csv").write_text('citation,text,title\nArt. 1 OR,"Der Vertrag\nkommt zustande",Abschluss\nArt. 2 OR,Mietzins und Miete,\nArt. 3 ZGB,guter Glaube,\nArt. 4 ZGB,Ermessen,\n')
    (tmp_path / "b.csv").write_text("citation,text,title\nArt. 2 OR,Pachtzins,\nArt. 9 ZGB,Register,\n")
    out = str(tmp_path / "index")
    first = jobs.main(["index", "--docs", str(tmp_path / "a.csv"), "--out", out, "--smoke", "Vertrag"], spark)
    assert (first["documents"], first["segments"], len(first["hits"])) == (4, 1, 1)
    second = jobs.main(["index", "--docs", str(tmp_path / "b.csv"), "--out", out, "--smoke", "Pachtzins"], spark)
    assert (second["documents"], second["segments"]) == (5, 2)
    with pytest.raises(RuntimeError):
        jobs.main(["index", "--out", out, "--smoke", "Mietzins"], spark)
    third = jobs.main(["index", "--out", out, "--remove", str(tmp_path / "b.csv"), "--merge", "--smoke", "Ermessen"], spark)
    assert (third["documents"], third["segments"]) == (3, 1)


def test_graph_job(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"citation": c, "text": t}) for c, t in (("BGE 1 II 1 E. 1", "Nach BGE 1 II 2 und Art. 1 OR"), ("BGE 1 II 2", "BGE 1 II 1, Art. 2 ZGB."), ("BGE 1 II 3", "x"))))
    (tmp_path / "l.csv").write_text("citation,text,title\nArt. 1 OR,siehe BGE 1 II 2,T\n")
    every = jobs.main(["graph", "--cases", str(tmp_path / "c.jsonl"), "--laws", str(tmp_path / "l.csv"), "--out", str(tmp_path / "g")], spark)
    assert every["nodes"] == 5 and set(every["files"]) == {"case_edges", "case_to_law_edges", "law_to_case_edges"} and (tmp_path / "g" / "graph" / "nodes").exists()
    few = jobs.main(["graph", "--cases", str(tmp_path / "c.jsonl"), "--laws", str(tmp_path / "l.csv"), "--out", str(tmp_path / "h"), "--no-laws", "--export-only", "--max-rows", "2"], spark)
    assert few["nodes"] == 2 and few["edges"] == 2 and few["files"] == ["case_edges"] and not (tmp_path / "h" / "graph").exists()
