import os

from versewise.sources import lyrics, sinks


def test_documents_are_flat_files(spark, tmp_path):
    rows = [(str(i), f"line {i}\n\nnext") for i in range(40)] + [("a.b", "dots"), ("_hidden", "x"), ("a/b", "y"), ("7", "zz"), ("e", "é")]
    path = str(tmp_path / "out")
    for _ in range(2):
        sinks.write_documents(spark.createDataFrame(rows, "recording_id string, body string"), path, "body")
    files = sorted(f for f in os.listdir(path) if f.endswith(".txt"))
    assert files == sorted([f"{i}.txt" for i in range(40)] + ["a.b.txt", "e.txt"])
    assert sum(os.path.isdir(os.path.join(path, f)) for f in os.listdir(path)) == 2
    got = {}
    for r in lyrics.read_plain(spark, path, "*").collect():
        got.setdefault(r.recording_id, []).append(r.text)
    assert len(got) == 44 and sorted(got["7"]) == ["line 7", "next", "zz"]
    assert got["a.b"] == ["dots"] and got["_hidden"] == ["x"] and got["e"] == ["é"]
    assert sorted(spark.read.text(path, recursiveFileLookup=True).where("value = 'y'").collect()) != []
