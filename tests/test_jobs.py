"""The command line jobs from text files to text files."""

import pytest
from pyspark.sql import functions as F

from catalog import star_graph as star
from kairograph.__main__ import main
from kairograph.plans import jobs
from kairograph.sources import ntriples, statements


def written(spark, path):
    return spark.read.option("recursiveFileLookup", "true").text(str(path))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Three snapshots of movies, actors and genres, one hub movie among them."""
    base = tmp_path_factory.mktemp("movies")
    ids = spark.range(300)
    rows = []
    for snapshot, date in enumerate(("170909", "171009", "171109")):
        n = F.col("id")
        movie = F.concat(F.lit("<http://imdb.org/movie/m"), n, F.lit(">"))
        actor = F.concat(F.lit("<http://imdb.org/actor/a"), n % 50, F.lit(">"))
        genre = F.concat(F.lit("<http://imdb.org/genre/g"), n % 4, F.lit(">"))
        foaf = "<http://xmlns.com/foaf/0.1/"
        lines = F.array(
            F.concat(movie, F.lit(f' {foaf}name> "Movie '), n, F.lit('" .')),
            F.concat(movie, F.lit(f' {foaf}year_of> "'), n % 7 + 1990, F.lit('" .')),
            F.concat(actor, F.lit(f' {foaf}name> "Actor '), n % 50, F.lit('" .')),
            F.concat(genre, F.lit(f' {foaf}name> "Genre '), n % 4, F.lit('" .')),
            F.concat(actor, F.lit(f" {foaf}acts_in> "), movie, F.lit(" .")),
            F.concat(movie, F.lit(f" {foaf}of_genre> "), genre, F.lit(" .")),
            F.concat(actor, F.lit(f" {foaf}likes> <http://imdb.org/movie/m{snapshot}> .")),
        )
        rows.append(ids.where(n % 5 != snapshot).select(F.lit(f"imdb-{date}.nt").alias("file"), F.explode(lines).alias("line")))
    for part in rows:
        name = part.first().file
        part.select("line").write.text(f"{base}/{name}")
    return base


def test_discover(spark, folder, tmp_path):
    main(["discover", f"{folder}/", "2", "170909", "171109", "0", f"{tmp_path}/out", "--min-count", "10"])
    rows = spark.read.parquet(f"{tmp_path}/out")
    assert rows.count() > 0
    assert rows.where("delta_min < 1 OR delta_min > delta_max OR delta_max > 2").count() == 0
    # (T - 1) / (N (T + 1)) bounds the support.
    assert rows.where("support > 2 / (n_tuples * 4) + 1e-12").count() == 0


def test_extend_file_by_file(spark, folder, tmp_path):
    """Three files added one after the other give what one job over all of them gives."""
    main(["discover", f"{folder}/", "2", "170909", "171109", "0", f"{tmp_path}/whole", "--min-count", "10"])
    for date in ("170909", "171009", "171109"):
        first = ["--begin", "2", "--min-count", "10"] if date == "170909" else []
        main(["extend", f"{tmp_path}/state", f"{folder}/imdb-{date}.nt", *first])
    main(["report", f"{tmp_path}/state", f"{tmp_path}/grown"])
    whole, grown = ([str(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()] for name in ("whole", "grown"))
    assert sorted(whole) == sorted(grown)


def test_sample_movies(spark, folder, tmp_path):
    main(["sample-movies", str(folder), f"{tmp_path}/out", "200"])
    lines, names = ntriples.load_folder(spark, f"{tmp_path}/out")
    assert names == ["imdb-170909.nt", "imdb-171009.nt", "imdb-171109.nt"]
    counts = {r.snapshot: r["count"] for r in lines.where(F.contains("line", F.lit("acts_in"))).groupBy("snapshot").count().collect()}
    assert set(counts) == {0, 1, 2} and max(counts.values()) <= 200


def test_sample_encyclopedia(spark, folder, tmp_path):
    renamed = tmp_path / "in"
    lines, names = ntriples.load_folder(spark, str(folder))
    for i, name in enumerate(names):
        here = lines.where(F.col("snapshot") == i)
        here.select(F.replace("line", F.lit("imdb.org"), F.lit("dbpedia.org"))).write.text(f"{renamed}/{name}")
    main(["sample-encyclopedia", str(renamed), f"{tmp_path}/out", "100", "20"])
    assert written(spark, tmp_path / "out").where("value LIKE '<http://dbpedia.org/%'").count() > 0


@pytest.mark.parametrize("by", ["vertex-type", "edge-label", "anchor", "grid"])
def test_partition(spark, folder, tmp_path, by):
    main(["partition", str(folder), f"{tmp_path}/out", "--by", by, "--parts", "3"])
    lines, names = ntriples.load_folder(spark, f"{tmp_path}/out")
    assert names == [f"imdb{part}-{date}.nt" for part in range(3) for date in ("170909", "171009", "171109")]
    if by in ("edge-label", "grid"):  # every edge is in exactly one part
        before = ntriples.parse_triples(ntriples.load_folder(spark, str(folder))[0], None).where("kind = 'edge'").count()
        # Edges that lead to a vertex without attributes have no line.
        dangling = before - ntriples.parse_triples(lines, None).where("kind = 'edge'").count()
        graph = jobs.build_graph(ntriples.parse_triples(ntriples.load_folder(spark, str(folder))[0], None), 3)
        assert dangling == graph.edges.count() - jobs.edges_within(graph.edges, graph.vertices).count()


def test_integrate_and_describe(spark, folder, sf_dir, tmp_path):
    lines = star.statement_lines(spark, sf_dir)
    for year in statements.YEARS:
        for kind in statements.KINDS:
            wanted = lines.where((F.col("year") == year) & (F.col("kind") == kind)).select("line")
            wanted.write.text(statements.statement_path(f"{tmp_path}/in", year, kind))
    main(["integrate", f"{tmp_path}/in", f"{tmp_path}/out"])
    expected = jobs.integrated_lines(statements.parse_statements(lines)).count()
    assert written(spark, tmp_path / "out").count() == expected
    main(["integrate", f"{tmp_path}/in", f"{tmp_path}/turtle", "--turtle"])
    assert written(spark, tmp_path / "turtle").exceptAll(written(spark, tmp_path / "out")).count() == 0
    assert written(spark, tmp_path / "turtle").count() == expected
    assert spark.read.parquet(f"{tmp_path}/turtle-rejected").count() == 0
    main(["describe", str(folder), f"{tmp_path}/about"])
    assert spark.read.parquet(f"{tmp_path}/about/counts").count() == 3
