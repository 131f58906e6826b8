"""Property graph as vertex and edge DataFrames, and bounded traversals of it.

Edges have `src`, `dst`, `type`. Loops write their frontier to the shared
folder and keep only vertices not seen before, so cycles end and a hub is
expanded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import known, squeeze
from canonry.operators.packed import split_packed
from canonry.session import written


def edge(df: DataFrame, src: Column, kind: str, dst: Column) -> DataFrame:
    """Edges of one type; rows without one end give none."""
    return df.select(src.cast("string").alias("src"), F.lit(kind).alias("type"), dst.cast("string").alias("dst")).where(F.col("src").isNotNull() & F.col("dst").isNotNull())


def document_edges(documents: DataFrame) -> DataFrame:
    """Distinct ISSUED_BY, SIGNED_BY, HAS_TYPE, BASED_ON, relation and HAS_ENTITY edges of document contexts, without sectors and the tree; sentinels are no nodes."""
    real = lambda c: squeeze(known(c, "N/A", "nan"))
    doc = F.col("doc_id")
    out = edge(documents, doc, "ISSUED_BY", real("issuing_auth")).unionByName(edge(documents, doc, "SIGNED_BY", real("signer_name"))).unionByName(edge(documents, doc, "HAS_TYPE", real("legal_type_meta")))
    basis = documents.select("doc_id", F.explode("basis_refs").alias("x"))
    out = out.unionByName(edge(basis, doc, "BASED_ON", real("x.doc_number")))
    relations = documents.select("doc_id", F.explode("ontology_rels").alias("x")).where(F.col("x.edge_label").isNotNull())
    named = relations.select(doc.alias("src"), F.col("x.edge_label").alias("type"), real("x.target_doc").alias("dst")).where(F.col("dst").isNotNull())
    entities = documents.select("doc_id", F.explode("entities").alias("label", "names")).select("doc_id", F.explode("names").alias("name"))
    return out.unionByName(named).unionByName(edge(entities, doc, "HAS_ENTITY", real("name"))).distinct()


def sector_edges(documents: DataFrame) -> DataFrame:
    """Distinct HAS_SECTOR edges of the sectors packed in `sectors_str`."""
    return edge(split_packed(documents, F.col("doc_id"), ["sectors_str"]), F.col("record_id"), "HAS_SECTOR", squeeze("val")).distinct()


def tree_edges(chunks: DataFrame) -> DataFrame:
    """Distinct edges of the tree of documents, articles, clauses and chunks; clauses only where the chunks have a `clause_ref`.

    The first chunk of an article or clause that is neither a table nor a
    continuation is that node itself; the others are chunks of their own. It
    is found by an aggregate, so an article of any size isn't gathered.
    """
    filled = lambda c: F.nullif(squeeze(c), F.lit(""))
    clause = filled("clause_ref") if "clause_ref" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.select("document_id", "chunk_id", "chunk_index", F.coalesce("is_table", F.lit(False)).alias("table"), filled("article_ref").alias("article"), clause.alias("clause")).distinct()
    more = F.coalesce(F.contains("clause", F.lit("(tiếp theo)")) | F.contains("clause", F.lit("[")), F.lit(False))
    bare = F.when(more, F.trim(F.regexp_replace("clause", r" \(tiếp theo\)|\[| tiếp theo\]", ""))).otherwise(F.col("clause"))
    article = F.concat_ws("_", "document_id", "article")
    rows = rows.withColumns({"more": more, "base": F.when(F.col("article").isNotNull(), bare), "article_id": F.when(F.col("article").isNotNull(), article)})
    rows = rows.withColumn("clause_id", F.concat(F.col("article_id"), F.lit("_"), F.col("base"))).withColumn("node", F.coalesce("clause_id", "article_id"))
    own = F.col("node").isNotNull() & ~F.col("table") & ~F.col("more")
    first = rows.where(own).groupBy("node").agg(F.min(F.struct("chunk_index", "chunk_id"))["chunk_id"].alias("leaf"))
    rows = rows.join(first, "node", "left").withColumn("part", ~F.coalesce(own & (F.col("chunk_id") == F.col("leaf")), F.lit(False)))
    parts = rows.where("part")
    out = edge(rows, F.col("document_id"), "HAS_ARTICLE", F.col("article_id")).unionByName(edge(rows, F.col("clause_id"), "PART_OF", F.col("article_id")))
    out = out.unionByName(edge(parts, F.col("chunk_id"), "PART_OF", F.col("node")))
    return out.unionByName(edge(parts.where(F.col("node").isNull()), F.col("chunk_id"), "BELONGS_TO", F.col("document_id"))).distinct()


def phantom_edges(relations: DataFrame) -> DataFrame:
    """Distinct BELONGS_TO edges from the articles that relations name to their documents: `id`, or one made of `number` where none is known; `article`."""
    owner = F.coalesce(F.col("id"), F.concat(F.lit("REF_"), F.col("number")))
    return edge(relations, F.concat(owner, F.lit("_"), F.nullif(squeeze("article"), F.lit(""))), "BELONGS_TO", owner).distinct()


def ghosts(edges: DataFrame, vertices: DataFrame, types: list[str]) -> DataFrame:
    """Vertices that are referred to by edges of `types` but don't exist, with the number of references."""
    cited = edges.where(F.col("type").isin(types)).groupBy("dst").agg(F.count("*").alias("refs"))
    return cited.join(vertices.select(F.col("id").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("id"), "refs")


def closure(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """`id`, `depth` of all vertices within `depth` steps of the seeds; each at its least depth.

    `edges` is read once a level, so it should be a table rather than a query.
    """
    frontier, _ = written(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    reached = frontier
    for step in range(1, depth + 1):
        following = edges.join(frontier, edges.src == frontier.id, "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier, new = written(following.join(reached, "id", "left_anti").withColumn("depth", F.lit(step)))
        if not new:
            break
        reached = reached.unionByName(frontier)
    return reached


def undirected(edges: DataFrame) -> DataFrame:
    """The edges in both directions."""
    return edges.select("src", "type", "dst").unionByName(edges.select(F.col("dst").alias("src"), "type", F.col("src").alias("dst")))


def shortest_path(edges: DataFrame, start: str | None, goal: str | None, most: int | None = None) -> DataFrame:
    """One row (`id`, `steps`) with the least number of undirected steps between two vertices, or none; `most` None is without bound.

    Breadth first from both ends, a level of the smaller side at a time. The
    sides first meet in their outermost levels, and the sum of the levels is
    then the distance. A null end gives no row.
    """
    spark = edges.sparkSession
    if start is None or goal is None:
        return spark.createDataFrame([], "id string, steps int")
    if start == goal:
        return spark.createDataFrame([(goal, 0)], "id string, steps int")
    both = undirected(edges).select("src", "dst")
    near = {end: both.where(F.col("src") == end).select(F.col("dst").alias("id")).distinct() for end in (start, goal)}
    # one or two steps are lookups that reach the scan
    at_once = near[start].where(F.col("id") == goal).select(F.lit(1).alias("steps")).limit(1)
    if most is None or most > 1:
        at_once = at_once.unionByName(near[start].join(near[goal], "id", "left_semi").select(F.lit(2).alias("steps")).limit(1))
    found = at_once.agg(F.min("steps")).first()[0]
    if found:
        return spark.createDataFrame([(goal, found)], "id string, steps int")
    sides = {end: written(near[end]) for end in (start, goal)} if most is None or most > 2 else {start: (None, 0), goal: (None, 0)}
    reached = {end: sides[end][0] for end in sides}
    steps = 2
    while sides[start][1] and sides[goal][1] and (most is None or steps < most):
        steps += 1
        own, other = sorted((start, goal), key=lambda end: sides[end][1])
        frontier = sides[own][0]
        following = both.join(frontier, both.src == frontier.id, "left_semi").select(F.col("dst").alias("id")).distinct()
        new = following.where(F.col("id") != own).join(reached[own], "id", "left_anti")
        marked = new.join(sides[other][0].select("id", F.lit(True).alias("met")), "id", "left")
        level, size, met = written(marked, "met")
        if met:
            return spark.createDataFrame([(goal, steps)], "id string, steps int")
        sides[own] = (level.select("id"), size)
        reached[own] = reached[own].unionByName(level.select("id"))
    return spark.createDataFrame([], "id string, steps int")


def chains(edges: DataFrame) -> DataFrame:
    """Directed chains of two and three different edges, as one row for each edge that begins some.

    `first`, `second` are the edge; `two` and `three` count the chains that
    go on from it, `onward` is its least third vertex. A chain may come back
    to a vertex but not use an edge twice; loops and repeated edges don't
    count. The rows are as many as the edges: the chains through a hub are
    not written out, and the third vertices of a row are the edges of `second`.
    """
    one = edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct()
    out = one.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("least"))
    # per vertex: edges that leave it, and chains of two that do
    further = one.join(out.select(F.col("src").alias("dst"), "n"), "dst").groupBy("src").agg(F.sum("n").alias("n2"))
    ahead = out.join(further, "src", "left").select(F.col("src").alias("dst"), "n", F.coalesce("n2", F.lit(0)).alias("n2"), "least")
    back = one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back"))
    begun = one.join(ahead, "dst").join(back, ["src", "dst"], "left")
    return begun.select(F.col("src").alias("first"), F.col("dst").alias("second"), F.col("n").alias("two"), (F.col("n2") - F.coalesce("back", F.lit(0))).alias("three"), F.col("least").alias("onward"))


def degrees(edges: DataFrame, end: str = "dst") -> DataFrame:
    """Number of edges at every vertex."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("degree"))


def rare_siblings(links: DataFrame, owner: str, item: str, below: int, least: int = 1) -> DataFrame:
    """Pairs of owners that share items used fewer than `below` times, with the number shared.

    The degree cap bounds the pairs of an item; items are counted before the
    self-join, and hot ones never reach it.
    """
    use = links.select(owner, item).distinct()
    rare = use.groupBy(item).agg(F.count("*").alias("__uses")).where((F.col("__uses") < below) & (F.col("__uses") > 1))
    few = use.join(rare.select(item), item, "left_semi")
    a, b = few.withColumnRenamed(owner, "a"), few.withColumnRenamed(owner, "b")
    return a.join(b, item).where(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def histogram(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Number of distinct vertices reached by undirected paths of exactly `hops` edges, by the type of the last edge."""
    both = undirected(edges)
    at = seeds.select(F.col("id").alias("at"))
    for hop in range(hops):
        step = both.join(at, both.src == F.col("at"), "left_semi").select("type", "dst").distinct()
        at = step.select(F.col("dst").alias("at")).distinct()
    return step.groupBy("type").agg(F.countDistinct("dst").alias("vertices"))


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key in the given order: an upsert's result without gathering a group."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def levels(chunks: DataFrame, document: str, article: str, order: list[str]) -> DataFrame:
    """`level`: the first row of an article is its node, later ones are leaves.

    The first is found by an aggregate, so an article of any size isn't
    gathered; `order` must be total within an article.
    """
    first = chunks.groupBy(document, article).agg(F.min(F.struct(*order)).alias("__first")).select(F.col(document).alias("__d"), F.col(article).alias("__a"), "__first")
    joined = chunks.join(first, chunks[document].eqNullSafe(F.col("__d")) & chunks[article].eqNullSafe(F.col("__a")))
    return joined.withColumn("level", F.when(F.struct(*order).eqNullSafe(F.col("__first")), "article").otherwise("leaf")).drop("__d", "__a", "__first")
