import random

from hopweave.operators.distance import closure
from hopweave.plans.graph import LabeledGraph
from hopweave.streaming.edges import maintained


def test_edges_that_arrive(spark, tmp_path):
    r = random.Random(3)
    rows = [(a, b, r.randint(1, 3)) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(30)) if a != b]
    schema = "src long, dst long, w int"
    for k in range(2):
        spark.createDataFrame(rows[k::2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    maintained(stream, f"file://{tmp_path}/out", 5, f"{tmp_path}/check").awaitTermination(200)
    g = LabeledGraph.of(spark.createDataFrame(rows, schema))
    want = {tuple(x) for x in closure(g.vertices, g.edges, 5).collect()}
    assert {tuple(x) for x in spark.read.parquet(f"{tmp_path}/out/batch=1").select("src", "dst", "d").collect()} == want
