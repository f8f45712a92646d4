from ripplet.operators import tables


def test_kind_groups_ranks_only_the_first_paths_of_a_kind(spark):
    rows = [(f"d/{i:03}.{'md' if i % 3 else 'ts' if i % 2 else 'css'}", 100 - i) for i in range(60)]
    files = spark.createDataFrame([*rows, (None, 1), ("LICENSE", 2), ("a/Dockerfile", 3), ("b\\\\c.PNG", 4), (".git/x", 5)], "path string, seq long")
    found = tables.kind_groups(files, files.select("path").where("path like '%.ts'"))
    expected = [("Markdown", 40, "d/059.md,d/058.md,d/056.md"), ("css", 10, "d/054.css,d/048.css,d/042.css"), ("other", 1, "LICENSE"), ("Docker", 1, "a/Dockerfile")]
    assert [tuple(r) for r in found.collect()] == expected
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
