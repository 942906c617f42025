import gzip

import numpy as np
import pandas as pd
import pytest

from edgeloom import cli
from edgeloom.operators import metrics
from edgeloom.operators.priors import prior_from_names
from edgeloom.sources import readers, sinks


def test_expression_and_square_csv(spark, tmp_path):
    f = tmp_path / "x.csv"
    pd.DataFrame([[1.5, 2.0], [3.0, 4.0]], index=["s1", "s2"], columns=["A", "B"]).to_csv(f)
    samples, variables = readers.read_expression_csv(spark, str(f))
    assert sorted(r.x for r in samples.collect()) == [[1.5, 2.0], [3.0, 4.0]]
    assert [r.var_name for r in variables.orderBy("var_id").collect()] == ["A", "B"]
    m = tmp_path / "m.csv"
    pd.DataFrame([[0, 1, 0], [1, 0, 7], [0, 7, 0]]).to_csv(m, index=False)
    edges, p = readers.read_square_csv(spark, str(m))
    assert p == 3 and {(r.i, r.j): r.value for r in edges.collect()} == {(0, 1): 1.0, (0, 2): 0.0, (1, 2): 7.0}
    np.save(tmp_path / "m.npy", np.array([[0, 2.0], [2.0, 0]]))
    assert readers.read_npy(spark, str(tmp_path / "m.npy"))[0].first().value == 2.0
    (tmp_path / "g.txt").write_text("A\n\n B \n")
    assert [r.var_name for r in readers.read_gene_order(spark, str(tmp_path / "g.txt")).orderBy("var_id").collect()] == ["A", "B"]
    assert {r.gene for r in readers.read_gene_list(spark, str(tmp_path / "g.txt")).collect()} == {"A", "B"}


def test_dream5_layouts(spark, tmp_path):
    (tmp_path / "net1_expression_data.tsv").write_text("gene\texp1\texp2\nG1\t1\t4\nG2\t2\t5\nG3\t3\t6\n")
    (tmp_path / "DREAM5_NetworkInference_GoldStandard_Network1.tsv").write_text("TF\ttarget\tlabel\nG1\tG2\t1\nG1\tG3\t0\n")
    samples, variables, gold = readers.load_dream5(spark, str(tmp_path), 1)
    assert [r.x for r in samples.orderBy("row_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert [tuple(r) for r in metrics.gold_truth(gold, variables).collect()] == [(0, 1)]
    other = tmp_path / "b"
    other.mkdir()
    (other / "net3_expression_data_avg.tsv").write_text("G1\tG2\tG3\n1\t2\t3\n4\t5\t6\n")
    (other / "in_silico_gold_standard.csv").write_text("from,to,weight\nG1,G3,0.4\n")
    samples, variables, gold = readers.load_dream5(spark, str(other), 3)
    assert samples.count() == 2 and gold.first().label == 1
    with pytest.raises(FileNotFoundError):
        readers.load_dream5(spark, str(tmp_path / "none"))


def test_sergio(spark, tmp_path):
    d = tmp_path / "myDS1"
    d.mkdir()
    for k in range(2):
        pd.DataFrame(np.arange(20).reshape(4, 5) + 100 * k).to_csv(d / f"simulated_noNoise_{k}.csv")
    (d / "gt_GRN.csv").write_text("1,2\n2,3\n3,2\n4,4\n")
    long, edges, p = readers.load_sergio(spark, str(tmp_path), 1)
    assert p == 4 and long.count() == 40 and long.select("row_id").distinct().count() == 10
    assert long.filter("row_id = 7 and var_id = 1").first().value == 107.0
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 2)]
    with pytest.raises(FileNotFoundError):
        readers.load_sergio(spark, str(tmp_path), 9)


def test_string_prior(spark, tmp_path):
    with gzip.open(tmp_path / "info.txt.gz", "wt") as f:
        f.write("#string_protein_id\tpreferred_name\np1\tA\np2\tB\np3\tC\n")
    with gzip.open(tmp_path / "links.txt.gz", "wt") as f:
        f.write("protein1 protein2 experiments\np1 p2 500\np2 p1 500\np1 p3 100\np3 p9 900\np2 p2 900\n")
    info = readers.read_string_info(spark, str(tmp_path / "info.txt.gz"))
    pairs = readers.read_string_edges(spark, str(tmp_path / "links.txt.gz"), info)
    assert [tuple(r) for r in pairs.collect()] == [("A", "B")]
    v = readers.variables_table(spark, ["B", "C", "A"])
    assert {(r.i, r.j) for r in prior_from_names(pairs, v, 3).filter("prior = 1").collect()} == {(0, 2)}


def test_annotated_matrix_selection(spark):
    layers = spark.createDataFrame(
        [(None, 0, 0, 1.0), (None, 1, 2, 2.0), ("log", 0, 1, 5.0)], "layer STRING, row_id BIGINT, var_id INT, value DOUBLE")
    var = spark.createDataFrame([(0, "a", True), (1, "b", False), (2, "c", True)], "var_id INT, var_name STRING, highly_variable BOOLEAN")
    get = lambda **k: [r.x for r in readers.from_anndata(layers, var, **k)[0].orderBy("row_id").collect()]
    assert get() == [[1.0, 0.0, 0.0], [0.0, 0.0, 2.0]]
    assert get(use_hvg=True) == [[1.0, 0.0], [0.0, 2.0]]
    assert get(genes=["c", "a"], use_hvg=True) == [[0.0, 1.0], [2.0, 0.0]]
    with pytest.raises(KeyError):
        get(layer="none")
    with pytest.raises(ValueError):
        get(genes=["z"])


def test_results_and_resume(spark, tmp_path):
    a = tmp_path / "results_hub_c_method_m_s02_rep001.csv"
    a.write_text("method,mcc\nm,0.5\n")
    b = tmp_path / "results_hub_c_method_m_rep001.csv"
    b.write_text("method,mcc,extra\nm,0.7,1\n")
    files = readers.find_results(spark, str(tmp_path), "results_")
    got = readers.read_results(spark, files, "synthetic")
    assert sorted((r.seed_offset, float(r.mcc)) for r in got.collect()) == [(0, 0.7), (2, 0.5)]
    out = str(tmp_path / "store")
    rows = spark.createDataFrame([("a", 1, 0.1), ("b", 1, 0.2)], "method STRING, rep INT, mcc DOUBLE")
    sinks.append_missing(rows, out, ["method", "rep"])
    more = rows.unionByName(spark.createDataFrame([("c", 1, 0.3)], rows.schema))
    sinks.append_missing(more, out, ["method", "rep"])
    assert spark.read.parquet(out).count() == 3


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((120, 4))
    x[:, 1] += x[:, 0]
    pd.DataFrame(x, columns=list("ABCD")).to_csv(tmp_path / "x.csv")
    assert cli.main(["run", "--data", str(tmp_path / "x.csv"), "--out", str(tmp_path)]) == 0
    part = lambda n: next((tmp_path / n).glob("part-*.csv"))
    adj = pd.read_csv(part("x_adjacency.csv")).to_numpy()
    assert adj[0, 1] == adj[1, 0] == 1 and np.trace(adj) == 0
    assert np.allclose(np.diag(pd.read_csv(part("x_pvalues.csv"))), 1.0)
    truth = tmp_path / "t.csv"
    pd.DataFrame([[0, 1, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]).to_csv(truth, index=False)
    assert cli.main(["evaluate", "--predicted", str(part("x_adjacency.csv")), "--ground-truth", str(truth), "--out", str(tmp_path / "m")]) == 0
    assert "recall: 1.0000" in capsys.readouterr().out
    assert cli.main(["simulate", "--n", "20", "--p", "6", "--reps", "1", "--out", str(tmp_path / "sim")]) == 0
    assert spark.read.parquet(str(tmp_path / "sim/topology=hub/n=20/p=6/seed=42/samples")).count() == 20
    np.save(tmp_path / "a.npy", adj)
    (tmp_path / "g.txt").write_text("A\nB\nC\nD\n")
    spark.createDataFrame([("t", "T", "T", "A"), ("t", "T", "T", "B"), ("t", "U", "U", "C"), ("t", "U", "U", "D")],
                          "db STRING, term_id STRING, term_name STRING, gene STRING").write.parquet(str(tmp_path / "terms"))
    assert cli.main(["enrich", "--adj", str(tmp_path / "a.npy"), "--genes", str(tmp_path / "g.txt"),
                     "--terms", str(tmp_path / "terms"), "--out", str(tmp_path / "e")]) == 0
    assert "T" in set(pd.read_csv(part("e"))["term_id"])


def test_equal_samples_stay_apart(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text("id,A,B\ns,1,2\ns,1,2\nt,3,4\ns,1,2\n")
    samples, _ = readers.read_expression_csv(spark, str(f))
    assert samples.count() == samples.select("row_id").distinct().count() == 4
    (tmp_path / "net1_expression_data.tsv").write_text("A\tB\n1\t2\n1\t2\n")
    (tmp_path / "in_silico_gold_standard.csv").write_text("from,to,weight\nA,B,1\n")
    samples, _, _ = readers.load_dream5(spark, str(tmp_path))
    assert samples.select("row_id").distinct().count() == 2


def test_repeated_gene_names_are_two_variables(spark, tmp_path):
    (tmp_path / "net1_expression_data.tsv").write_text("gene\te1\te2\nG\t1\t4\nH\t2\t5\nG\t3\t6\n")
    (tmp_path / "in_silico_gold_standard.csv").write_text("from,to,weight\nG,H,1\n")
    samples, variables, _ = readers.load_dream5(spark, str(tmp_path))
    assert [r.x for r in samples.orderBy("row_id").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert variables.count() == 3


def test_append_csv_keeps_one_header(spark, tmp_path):
    for k in range(3):
        sinks.append_csv(spark.createDataFrame([(k, "v")], "k int, name string"), str(tmp_path / "out"))
    got = spark.read.csv(str(tmp_path / "out"), header=True)
    assert got.columns == ["k", "name"] and sorted(r.k for r in got.collect()) == ["0", "1", "2"]
