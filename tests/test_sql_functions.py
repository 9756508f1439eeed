from pyspark.sql import functions as F

from normloom.functions import sql
from normloom.functions import text as T
from normloom.operators import citations, graph


def test_sql_functions_equal_columns(spark):
    names = sql.register(spark)
    values = ["Straßengesetzes (Kurz)", "É à-1 <b>x</b>\xa0 y", "9x", "½ ﬁx Ⅳ ① ｗ ǆ", None, "", "Nach § 242 BGB und Art. 5 der Hausordnung"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    df.createOrReplaceTempView("values_here")
    for name in ("strip_tags", "norm_title", "norm_abbr", "normalize_book", "main_group"):
        got = [r[0] for r in spark.sql(f"select {name}(s) from values_here order by i").collect()]
        assert got == [r[0] for r in df.orderBy("i").select(getattr(T, name)(F.col("s"))).collect()], name
    assert spark.sql("select size_of_degree(25)").first()[0] == spark.range(25, 26).select(graph.size_of(F.col("id"))).first()[0]
    got = spark.sql("select i, c.* from values_here, lateral extract_citations(s) c order by i, cit_pos").collect()
    want = df.select("i", F.posexplode(citations.citations_of(T.strip_tags(F.col("s")))).alias("p", "c")).orderBy("i", "p").collect()
    assert [(r["span_text"], r["number"], r["book"], r["confidence"]) for r in got] == [(r["c"]["span_text"], r["c"]["number"], r["c"]["book"], r["c"]["confidence"]) for r in want]
    assert len(got) == 2 and "extract_citations" in names
