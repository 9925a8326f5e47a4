from hopweave.sources import sinks, text


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return f"file://{path}"


def test_edges_and_labels(spark, tmp_path):
    at = write(tmp_path / "e", ["# no", "1,2", "3,,4,5", "", "5,6,7,8", "x,9", "* stop", "7,8"])
    assert {tuple(x) for x in text.read_edges(spark, at).collect()} == {(1, 2, 1), (3, 4, 5), (5, 6, 7), (0, 9, 1)}
    at = write(tmp_path / "l", ["1,2", "2,3", "1,4"])
    assert {tuple(x) for x in text.read_labels(spark, at).collect()} == {(1, 4), (2, 3)}


def test_index_files(spark, tmp_path):
    at = write(tmp_path / "h", ["1,0,2,3", "1,1,2", "4,1,5,9"])
    assert {tuple(x) for x in text.read_hub_labels(spark, at, delta=5).collect()} == {(1, 0, 2, 3)}
    at = write(tmp_path / "v", ["1,0,-1,3"])
    assert [tuple(x) for x in text.read_vectors(spark, at).collect()] == [(1, [0, None, 3])]
    at = write(tmp_path / "c", ["0,7,2,7,8,9"])
    assert [x.member for x in text.read_clusters(spark, at).collect()] == [7, 8, 9]
    at = write(tmp_path / "r", ["0,1,5,6"])
    assert [tuple(x) for x in text.read_relation(spark, at).collect()] == [(0, 1, 5, 6)] and text.read_relation_graph(spark, at).columns == ["l0", "l1", "l2", "l3"]


def test_dictionary(spark, tmp_path):
    e = write(tmp_path / "e", ["30\t10", "10\t20", "30\t40"])
    l = write(tmp_path / "l", ["10,7", "99,8", "40,5", "20,7"])
    edges, labels = text.encoded(spark, e, l)
    assert {tuple(x) for x in edges.collect()} == {(0, 1), (1, 2), (0, 3)}
    assert {tuple(x) for x in labels.collect()} == {(1, 1), (3, 2), (2, 1)}


def test_lines_read_back(spark, tmp_path):
    v = spark.createDataFrame([(1, [0, None, 2])], "vid long, v array<int>")
    sinks.write_lines(sinks.vector_lines(v), f"file://{tmp_path}/out")
    assert [tuple(x) for x in text.read_vectors(spark, f"file://{tmp_path}/out").collect()] == [(1, [0, None, 2])]
    rel = spark.createDataFrame([(0, 1, 5, 6), (0, 1, 5, 7)], "i int, j int, x long, y long")
    assert [x.line for x in sinks.edge_lines(rel).collect()] == ["[0-1],[5-6],[5-7]"]
    dom = spark.createDataFrame([(0, 5), (1, 6), (1, 8)], "label int, vid long")
    assert sorted(x.line for x in sinks.support_lines(dom, rel).collect()) == ["0,5,2,[1-6],[1-7],0", "1,6,0,1,(0-5)", "1,8,0,0"]
    assert sorted(x.line for x in sinks.support_lines(dom, rel, counts=False).collect()) == ["0,5,[1-6],[1-7]", "1,6,(0-5)", "1,8"]


def test_rows_mapped_and_files_written(spark, tmp_path):
    at = write(tmp_path / "m", ["1,2,3", "# no", "4,5"])
    assert sorted(map(tuple, text.read_mapped(spark, at, lambda c: [(c[0], len(c)), (c[1], 0)], "x long, n int").collect())) == [(1, 3), (2, 0), (4, 2), (5, 0)]
    at = write(tmp_path / "p", ["7,1,-1,3"])
    assert [tuple(x) for x in text.read_vectors(spark, at, dims=2).collect()] == [(7, [1, None])]
    e = write(tmp_path / "e", ["30\t10", "10\t20"])
    l = write(tmp_path / "l", ["10,7", "20,9"])
    text.write_encoded(spark, e, l, f"file://{tmp_path}/e2", f"file://{tmp_path}/l2")
    assert {tuple(x) for x in text.read_edges(spark, f"file://{tmp_path}/e2").select("src", "dst").collect()} == {(0, 1), (1, 2)}
    assert {tuple(x) for x in text.read_labels(spark, f"file://{tmp_path}/l2").collect()} == {(1, 1), (2, 2)}
    sinks.write_text(spark, f"file://{tmp_path}/log", "one\n")
    assert (tmp_path / "log").read_text() == "one\n"
