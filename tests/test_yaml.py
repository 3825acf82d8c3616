import pytest
import yaml

from millrace.plans.sizing import scratch_path
from millrace.sources import readers

TEXTS = {
    "list": "# all\n- {a: 1, b: x}\n\n- a: 2\n  b: |\n    - kept\n    - text\n-\n  a: 3\n",
    "quote": '- {a: 4, b: "one\n- {a: 5, b: two"}\n- {a: 6}\n',
    "names": "- &n {a: 7}\n- {a: 8}\n- *n\n",
    "map": "a: 9\nb: y\n",
    "keyed": "a:\n- 10\n- 11\n",
    "stream": "- {a: 12}\n---\n- {a: 13}\n---\na: 14\n",
    "plain": "word\n- no list\n",
    "windows": "- {a: 15}\r\n- {a: 16}\r\n",
    "none": "",
}


@pytest.mark.parametrize("chunk", [1, 1 << 16])
def test_pieces_give_what_whole_files_give(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(readers, "YAML_CHUNK", chunk)
    for name, text in TEXTS.items():
        (tmp_path / name).write_text(text, newline="")
    want = []
    for text in TEXTS.values():
        for doc in yaml.safe_load_all(text):
            want += [d for d in (doc if isinstance(doc, list) else [doc]) if d is not None]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got = readers.load_yaml(spark, str(tmp_path), flat=False)
        assert got.count() == len(want)
        pieces = readers._yaml_items(spark, str(tmp_path / "list"), None)
        assert pieces.rdd.getNumPartitions() > 1 and pieces.where("line is null").count() == 0
        assert sorted(r["a"] for r in got.where("a is not null and a not like '[%'").collect()) == sorted(str(d["a"]) for d in want if isinstance(d, dict) and not isinstance(d["a"], list))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
