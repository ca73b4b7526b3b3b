import pytest

from retort import cli, tools


def test_facades(spark):
    assert tools.similar(["c1ccccc1C(=O)O"], ["CCO", "c1ccccc1C(=O)O"], 1)[0]["hits"] == [{"smiles": "c1ccccc1C(=O)O", "similarity": 1.0}]
    assert tools.screen(["CCO"], ["CCO", "c1ccccc1"])["n_hits"] == 1
    assert tools.smarts(["CC(=O)O", "CCO"], "C(=O)O")["n_matched"] == 1
    assert tools.scaffold(["Cc1ccccc1", "CCO", "BAD"], "cluster")["clusters"] == {"c1ccccc1": ["Cc1ccccc1"], "__acyclic__": ["CCO"], "__invalid__": ["BAD"]}
    assert tools.reaction(["CC(=O)O"], "[C:1](=[O:2])[OH:3]>>[C:1](=[O:2])[O:3]C", "enumerate")["products"] == ["C(C)(=O)OC"]
    assert tools.featurize(["C"])["on_bits"] == [[1221]]
    assert tools.descriptors(["CCO"], ["HeavyAtomCount"])["values"] == [[3.0]]
    with pytest.raises(ValueError):
        tools.scaffold(["C"], "nothing")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "q.smi").write_text("c1ccccc1C(=O)O\n")
    (tmp_path / "l.smi").write_text("CCO\nc1ccccc1C(=O)O x\nc1ccccc1\n")
    cli.main(["screen", str(tmp_path / "q.smi"), str(tmp_path / "l.smi"), "--top-k", "2"])
    assert capsys.readouterr().out.splitlines()[0] == "1\tc1ccccc1C(=O)O\t1.0000"
    cli.main(["admet-screen", str(tmp_path / "l.smi"), "--output", str(tmp_path / "admet")])
    assert "Drug-like:" in capsys.readouterr().out
    cli.main(["scaffold-split", str(tmp_path / "l.smi"), "--output", str(tmp_path / "splits")])
    assert (tmp_path / "splits").is_dir()
    cli.main(["featurize", str(tmp_path / "l.smi"), "--output", str(tmp_path / "fps")])
    cli.main(["benchmark", "--n", "100", "--repeats", "1"])
    assert "molecules a second" in capsys.readouterr().out
