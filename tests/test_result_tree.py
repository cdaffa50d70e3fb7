"""Result files of many layouts below one folder."""

from __future__ import annotations

import pytest

from quillsieve.sources import tables as tb


def test_layouts(spark, tmp_path):
    files = {
        "a/x.csv": 'model,task,metric,original_value\nm,t,acc,\nm,t,acc,0.5\nm,"t,2",acc,0.25\nm,"say \\"x, y\\"",acc,3\n,z,acc,4\n',
        "a/y.csv": 'original_value, task ,extra,"model",metric\n0.9,t,z,m,acc\n0.75,u,"a,b,c",m,acc\n',
        "b/deep/z.csv": "task,model,metric\nt,m,acc\n",
        "b/short.csv": "model,task,metric,original_value\nm,v\n n , v ,f1,nan\nk,v,f1,7,8\n",
        "b/empty.csv": "",
        "b/names.txt": "model,task,metric,original_value\nm,w,acc,1\n",
    }
    for i in range(40):
        files[f"many/{i:02}.csv"] = f"c{i},model,metric,task,original_value\n{i},many,acc,t{i % 4},{i}\n"
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = {(r[0], r[1], r[2]): r[3] for r in tb.scan_result_tree(spark, str(tmp_path)).collect()}
    # a value that is no number, as in the row of "n", is none
    assert got == {
        ("m", "t", "acc"): 0.5, ("m", "t,2", "acc"): 0.25, ("m", 'say "x, y"', "acc"): 3.0, (None, "z", "acc"): 4.0, ("m", "u", "acc"): 0.75, ("k", "v", "f1"): 7.0,
        **{("many", f"t{i}", "acc"): float(i) for i in range(4)},
    }


def test_no_file_has_the_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    with pytest.raises(FileNotFoundError):
        tb.scan_result_tree(spark, str(tmp_path))
