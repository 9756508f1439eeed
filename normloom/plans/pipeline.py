"""The whole build over DataFrames.

What several later stages read (classified laws, references, edges, places) is
written once into the shared folder; all else stays lazy.
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.functions.text import embedding_text, node_id
from normloom.operators import citations, color, graph, layout, resolve, search, taxonomy, validate, vectors
from normloom.runtime import written
from normloom.sources import sinks
from normloom.sources.laws import slug_table

#: Scale of the height that a principal component gives.
Z_SCALE = 6000.0


@dataclass
class Build:
    classified: DataFrame
    refs: DataFrame
    resolver: DataFrame
    edges: DataFrame
    nodes: DataFrame
    search_docs: DataFrame
    stats: DataFrame
    checks: DataFrame


def build(laws: DataFrame, toc: DataFrame, entries: DataFrame, embeddings: DataFrame | None = None, k: int = 5, soft_weight: float = 0.1, iterations: int = 50, mode: str = "ordered", jurisdiction: str = "de-bund", z_scale: float | None = Z_SCALE) -> Build:
    """From parsed laws (slug, names, norms), the table of contents and taxonomy entries to the coloured graph.

    ``embeddings`` has slug and embedding; without it hashed words stand in.  Nodes get the first principal component
    of their vectors times ``z_scale`` as their height, 0 without a vector; with None they have none.
    """
    opening = laws.withColumn("opening_text", taxonomy.opening_text(F.col("norms"))).drop("norms", "parse_warnings")
    codes = taxonomy.join_taxonomy(toc, slug_table(laws), *taxonomy.join_maps(taxonomy.distinct_entries(entries)))
    classified = written(taxonomy.classify(opening, codes), "classified")

    norms = laws.select(F.col("slug").alias("source_slug"), F.posexplode("norms").alias("norm_pos", "n")).select("source_slug", "norm_pos", "n.text_xml")
    refs = written(citations.extract(norms, ["source_slug", "norm_pos"]), "refs")
    ordered = laws.select("slug", "jurabk", "langue").join(toc.select("slug", "ord"), "slug", "left")
    resolved = resolve.resolve(refs, resolve.book_index(ordered, toc), laws.select("slug", "jurabk"), jurisdiction)
    hard = resolve.edges(resolved)

    if embeddings is None:
        texts = classified.select("slug", embedding_text(F.col("langue"), F.col("slug"), F.col("opening_text")).alias("t"))
        embeddings = vectors.hashed_embedding(texts, "slug", "t")
    named = classified.select("slug", "main_group", node_id(F.col("jurabk"), F.col("slug"), jurisdiction).alias("id"))
    base = written(embeddings.join(named, "slug").select("slug", "id", "main_group", vectors.unit(F.col("embedding")).alias("v")), "base")
    soft = vectors.soft_edges(base.filter("main_group is null").drop("slug"), base.drop("slug"), k, soft_weight).drop("cos")
    none = [F.lit(None).cast("date").alias(c) for c in ("valid_from", "valid_to")]
    edges = written(graph.union_edges(hard, soft.select("*", *none)), "edges")

    nodes = graph.build_graph(classified, edges, jurisdiction).drop("x", "y", "color", "meta_cluster")
    places = layout.run_layout(nodes, edges, iterations)
    if z_scale is not None:
        heights = vectors.pca_z(base.select(F.struct("id", "slug").alias("id"), "v"), scale=z_scale)
        # Of several laws of one node the last slug counts.
        places = layout.attach_z(places, heights.groupBy("id.id").agg(F.max_by("z", "id.slug").alias("z")))
    nodes = written(layout.merge_layout(nodes, places), "nodes")
    flat = nodes.select("id", F.col("classification.main_group").alias("main_group"))
    nodes = nodes.join(color.assign_colors(flat, edges, mode).withColumnRenamed("cluster", "meta_cluster"), "id", "left")
    resolver = resolve.resolver(resolved)
    return Build(
        classified, refs, resolver, edges, nodes, search.search_docs(nodes, classified, jurisdiction=jurisdiction),
        resolve.stats(resolved), validate.validate(flat, edges, resolver),
    )


def write_bundle(built: Build, path: str) -> dict[str, int]:
    """The files of the front end in a local folder, fetched one partition at a time; returns how many entries each has."""
    at, nodes, rounded = Path(path), built.nodes.orderBy("id"), lambda c: F.round(c, 6).alias(c)
    edges = built.edges.orderBy("source", "target", "type")
    spark = nodes.sparkSession
    places = nodes.select("id", F.struct(*[rounded(c) for c in "xyz"]).alias("place"))
    return {
        "nodes.json": sinks.write_json_array(nodes, str(at / "nodes.json"), keep_null=("repealed_at", "meta_cluster")),
        "edges.json": sinks.write_json_array(edges, str(at / "edges.json"), keep_null=("valid_from", "valid_to")),
        "layout.json": sinks.write_json_map(places, "id", "place", str(at / "layout.json")),
        "meta-taxonomy.json": sinks.write_json_array(color.meta_taxonomy(spark).orderBy("main_group"), str(at / "meta-taxonomy.json")),
        "reference-resolver.json": sinks.write_json_map(built.resolver, "span_key", "node_id", str(at / "reference-resolver.json")),
        "search-index.json": sinks.write_json_array(built.search_docs.orderBy("id"), str(at / "search-index.json")),
    }
