"""Whole scopes: a catalogue of what stands under each heading, and the source scope that a target's leaf stands for.

A leaf may change its words and grow, so its heading and unchanged paragraphs locate the source: a heading with the same
key, or two unchanged paragraphs in order where the heading was renamed. Scopes nest; a block lies in all that are open
at it, which its array of open headings tells, so no pair of a block and a scope is searched for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators.blocks import in_order, open_headings, scope_end
from quillmesh.plans.store import written


def outlined(blocks: DataFrame) -> DataFrame:
    """``blocks`` (``doc, index, text, level, heading, is_toc``) with ``path, open, scope_end`` and ``at``, the innermost
    open heading's place."""
    return scope_end(open_headings(blocks)).withColumn("at", F.get("open", F.size("open") - 1))


def body_of(texts: Column) -> Column:
    """The form in which bodies are compared: no white space at all."""
    return F.regexp_replace(F.array_join(texts, ""), r"[ \t-\r]+", "")


def scope_catalogue(outline: DataFrame, least_key: int = 4) -> DataFrame:
    """``doc, at, title, key, outside, start, end, leaf, body`` of each heading's scope, as nested intervals [start, end).

    Empty blocks at the end don't count, and a scope without a text is none. ``outside`` has the keys of the headings
    above that are specific enough, ``body`` the joined texts of all blocks inside, headings too. Rows of ``outline`` are
    those of :func:`outlined`. A block is passed on once for each scope that is open at it.
    """
    inside = outline.where("NOT is_toc").select("doc", "index", "text", "heading", F.explode(F.array_except("open", F.when(F.col("heading"), F.array("index")).otherwise(F.slice("open", 1, 0)))).alias("at"))
    filled = F.trim("text") != ""
    # a scope's texts are put together, which takes memory of a chapter's size at most
    texts = F.array_sort(F.collect_list(F.when(filled, F.struct("index", "text")))).alias("texts")
    bodies = inside.groupBy("doc", "at").agg((F.max(F.when(filled, F.col("index"))) + 1).alias("end"), texts, F.bool_and(~F.col("heading")).alias("leaf")).where("end IS NOT NULL")
    keys = F.filter(F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda p: T.title_key(p)), lambda k: F.length(k) >= least_key)
    heads = outline.where("heading AND NOT is_toc").select("doc", F.col("index").alias("at"), F.col("text").alias("title"), T.title_key("text").alias("key"), keys.alias("outside"), (F.col("index") + 1).alias("start"))
    return heads.join(bodies, ["doc", "at"]).select("doc", "at", "title", "key", "outside", "start", "end", "leaf", body_of(F.transform("texts", lambda t: t["text"])).alias("body"))


def unique_anchors(targets: DataFrame, sources: DataFrame, least: int = 20) -> DataFrame:
    """``doc, index, at, source_doc, source_index, source_open``: paragraphs of ``least`` characters that a target has
    unchanged and the sources have at one place alone. Rows are those of :func:`outlined`."""
    form = F.regexp_replace("text", r"[ \t-\r]+", "")
    own = targets.where("NOT heading").select("doc", "index", "at", form.alias("form")).where(F.length("form") >= least)
    other = sources.where("NOT heading").select(F.col("doc").alias("source_doc"), F.col("index").alias("source_index"), F.col("open").alias("source_open"), form.alias("form"))
    once = other.where(F.length("form") >= least).groupBy("form").agg(F.count("*").alias("n_"), F.min(F.struct("source_doc", "source_index", "source_open")).alias("s")).where("n_ = 1")
    return own.join(once, "form").select("doc", "index", "at", "s.source_doc", "s.source_index", "s.source_open")


def longest_chain(places: Column) -> Column:
    """Length of the longest strictly increasing subsequence of an array, by the least end of a chain of each length."""
    step = lambda ends, x: F.concat(F.filter(ends, lambda e: e < x), F.array(x), F.slice(ends, F.size(F.filter(ends, lambda e: e < x)) + 2, F.size(ends)))
    return F.size(F.aggregate(places, F.slice(places, 1, 0), step))


def anchor_chains(anchors: DataFrame) -> DataFrame:
    """``doc, at, source_doc, source_at, n_anchors, chain, in_order, shared`` for each target heading and source scope
    that anchors join: their number, the longest ordered chain, whether all are in order, and whether anchors of
    another heading of the document lie in that source scope as well."""
    met = anchors.where("at IS NOT NULL").select("doc", "at", "index", "source_doc", "source_index", F.explode("source_open").alias("source_at")).distinct()
    # places of one target heading in one source scope: bounded by the heading's own paragraphs
    chains = met.groupBy("doc", "at", "source_doc", "source_at").agg(F.count_distinct("source_index").alias("n_anchors"), F.transform(F.array_sort(F.collect_list(F.struct("index", "source_index"))), lambda x: x["source_index"]).alias("places"))
    ordered = F.forall(F.sequence(F.lit(1), F.size("places")), lambda i: (i == F.size("places")) | (F.get("places", i) >= F.get("places", i - 1)))
    scope = Window.partitionBy("doc", "source_doc", "source_at")
    return chains.select("doc", "at", "source_doc", "source_at", "n_anchors", longest_chain(F.col("places")).alias("chain"), ordered.alias("in_order"), (F.min("at").over(scope) != F.max("at").over(scope)).alias("shared"))


def reconcile_scopes(targets: DataFrame, sources: DataFrame, anchors: DataFrame, *, least_key: int = 4, least_chain: int = 2, all_in_order: bool = True, leading: Column | None = None) -> DataFrame:
    """The source scope of each target leaf: ``doc, at, start, end, source_doc, source_at, source_start, source_end,
    renamed, same, n_versions, n_docs, status``.

    ``targets`` and ``sources`` are :func:`scope_catalogue` tables, ``anchors`` as of :func:`unique_anchors`. Leaves
    alone take part, with keys of ``least_key`` characters. A source scope is a candidate if its key is the same and it
    has an anchor or a heading above in common, or, where it is renamed, if it holds a chain of ``least_chain`` anchors
    (all of the leaf's anchors there in order, unless ``all_in_order`` is false). Scopes with anchors of other headings
    of the document are split among them and don't count. Same headings go before renamed ones. A shorter body that a
    longer one of the same document and heading has within it goes. Equal bodies are one version: the only one, the
    target's own, or the one that more source documents have (two at least) is taken (``auto``); otherwise the
    first place is shown for ``review``, the target's own before others. Where ``leading``
    marks documents (a column over the sources' ``doc``) and a candidate of another document differs from all of theirs,
    only theirs are versions.

    Leaves of one key under the same headings have the same candidates but where anchors of their own documents tell
    them apart. So candidates are listed and counted once for all leaves of a kind; a leaf takes from the list the few
    that can come first, and what its anchors change is counted on its own. Only ``leading`` pairs each leaf with each
    candidate. Bodies are compared by their SHA-256.
    """
    leaf = targets.where(F.col("leaf") & (F.length("key") >= least_key)).select("doc", "at", "start", "end", "key", "outside", F.sha2("body", 256).alias("own_"))
    leaf = written(leaf, "leaves")
    renamed = {c: f"source_{c}" for c in ("doc", "at", "outside", "start", "end", "body")}
    full = written(sources.where("leaf").select(*(F.col(c).alias(n) for c, n in renamed.items()), F.col("key").alias("s_key"), F.sha2("body", 256).alias("digest")), "source-leaves")
    s, bodies = full.drop("source_body"), full.select("source_doc", "source_at", "source_body")
    chains = written(anchor_chains(anchors), "chains")
    one, kind, place = ["doc", "at"], ["key", "outside"], ["source_doc", "source_at"]

    def longest(rows: DataFrame, *by: str) -> DataFrame:
        """Without bodies that a longer one of the same group has within it; most groups are of one row."""
        rows = rows.withColumn("n_", F.count("*").over(Window.partitionBy(*by)))
        within = Window.partitionBy(*by).orderBy(F.desc(F.length("source_body")), "source_start")
        longer = F.collect_list(F.struct("source_body")).over(within.rowsBetween(Window.unboundedPreceding, -1))
        some = rows.where("n_ > 1").join(bodies, place).withColumn("longer_", longer)
        some = some.where(~F.exists("longer_", lambda x: (F.length(x["source_body"]) > F.length("source_body")) & F.contains(x["source_body"], F.col("source_body"))))
        return rows.where("n_ = 1").unionByName(some.drop("longer_", "source_body")).drop("n_")

    # of each kind of leaf, the scopes of the same key that have a heading above in common
    above = leaf.select(*kind).distinct().withColumn("above_", F.explode(F.array_distinct("outside")))
    under = s.withColumnRenamed("s_key", "key").withColumn("above_", F.explode(F.array_distinct("source_outside"))).drop("source_outside")
    shared = above.join(under, ["key", "above_"]).drop("above_").dropDuplicates([*kind, *place])
    shared = written(longest(written(shared, "candidates"), *kind, "source_doc"), "candidates")

    # documents where a leaf's anchors, or those of its document, decide: their scopes are judged for each leaf
    met = chains.select("doc", *place).distinct().withColumn("met_", F.lit(True))
    split = chains.where("shared").select("doc", *place).distinct().withColumn("split_", F.lit(True))
    judged = leaf.join(met.join(s.select(*place, F.col("s_key").alias("key")), place).select("doc", "key", "source_doc").distinct(), ["doc", "key"])
    judged = written(judged.select(*one, *kind, "source_doc"), "judged")
    special = judged.join(s.withColumnRenamed("s_key", "key"), ["key", "source_doc"]).join(chains.select(*one, *place, F.lit(True).alias("has_")), [*one, *place], "left")
    special = special.join(met, ["doc", *place], "left").join(split, ["doc", *place], "left")
    own = F.col("has_").isNotNull()
    special = special.where(F.col("split_").isNull() & (own | F.col("met_").isNull()) & (own | F.arrays_overlap("outside", "source_outside"))).drop("has_", "met_", "split_", "source_outside")
    special = written(longest(written(special, "special"), *one, "source_doc"), "special")

    def counted(rows: DataFrame) -> DataFrame:
        group = Window.partitionBy(*one)
        if leading is not None:
            rows = rows.withColumn("leads_", leading).withColumn("known_", F.max("leads_").over(Window.partitionBy(*one, "digest")))
            clash = F.max("leads_").over(group) & ~F.min("known_").over(group)
            rows = rows.withColumn("clash_", clash).where("leads_ OR NOT clash_").drop("leads_", "known_", "clash_")
        rows = rows.withColumn("n_docs", F.size(F.collect_set("source_doc").over(Window.partitionBy(*one, "digest"))))
        return rows.withColumn("n_versions", F.size(F.collect_set("digest").over(group)))

    columns = [*one, *place, "source_start", "source_end", "digest"]
    if leading is None:
        same_key = _ahead(leaf, shared, judged, special).select(*columns, "n_docs", "n_versions")
    else:
        every = leaf.join(shared, kind).join(judged.select(*one, "source_doc"), [*one, "source_doc"], "left_anti").select(*columns)
        same_key = counted(every.unionByName(special.select(*columns))).select(*columns, "n_docs", "n_versions")
    same_key = written(same_key, "same-key")
    ordered = F.col("in_order") if all_in_order else F.lit(True)
    moved = chains.where((F.col("chain") >= least_chain) & ordered & ~F.col("shared")).join(leaf, one).join(s, place).where("key != s_key").join(same_key.select(*one).distinct(), one, "left_anti")
    moved = counted(longest(written(moved.select(*columns, "s_key"), "moved"), *one, "source_doc", "s_key")).select(*same_key.columns)

    group = Window.partitionBy(*one)
    found = leaf.join(same_key.withColumn("renamed", F.lit(False)).unionByName(moved.withColumn("renamed", F.lit(True))), one).withColumn("same", F.col("own_") == F.col("digest"))
    found = found.withColumns({"any_same_": F.max("same").over(group), "most_": F.max("n_docs").over(group)})
    leads = F.size(F.collect_set(F.when(F.col("n_docs") == F.col("most_"), F.col("digest"))).over(group)) == 1
    found = found.withColumn("sure_", (F.col("n_versions") == 1) | F.col("any_same_") | ((F.col("most_") >= 2) & leads))
    taken = F.col("sure_") & F.when(F.col("any_same_"), F.col("same")).otherwise(F.col("n_docs") == F.col("most_"))
    ranked = found.withColumn("rank_", F.row_number().over(group.orderBy(F.desc(taken), F.desc("same"), "source_doc", "source_start"))).where("rank_ = 1")
    status = F.when(F.col("sure_"), "auto").otherwise("review").alias("status")
    return ranked.select("doc", "at", "start", "end", "source_doc", "source_at", "source_start", "source_end", "renamed", "same", "n_versions", "n_docs", status)


def _ahead(leaf: DataFrame, shared: DataFrame, judged: DataFrame, special: DataFrame) -> DataFrame:
    """Candidates of each leaf that can be shown or decide, with ``n_docs`` of their versions and ``n_versions``.

    ``shared``: candidates of each kind of leaf; in the ``judged`` documents (k of a leaf) the ``special`` ones stand
    instead. That changes the counts of T versions. So what comes first among the leaf's own candidates is in the first
    k + 1 documents of the list, and the version that most documents have among the first T + 2, the changed ones and
    the leaf's own; of a version, the first k + 1 documents are enough.
    """
    one, kind, version = ["doc", "at"], ["key", "outside"], ["key", "outside", "digest"]
    listed = shared.withColumn("n_", F.row_number().over(Window.partitionBy(*version, "source_doc").orderBy("source_start"))).where("n_ = 1").drop("n_")
    listed = listed.withColumn("n_docs", F.count("*").over(Window.partitionBy(*version))).withColumn("in_version_", F.row_number().over(Window.partitionBy(*version).orderBy("source_doc")))
    listed = listed.withColumn("in_list_", F.dense_rank().over(Window.partitionBy(*kind).orderBy("source_doc")))
    listed = written(listed.withColumn("version_", F.dense_rank().over(Window.partitionBy(*kind).orderBy(F.desc("n_docs"), "digest"))), "listed")
    counts = listed.where("in_version_ = 1").select(*version, "n_docs")

    less = judged.join(listed, [*kind, "source_doc"]).groupBy(*one, *version).agg(F.count("*").alias("n_"))
    more = special.groupBy(*one, *version).agg(F.count_distinct("source_doc").alias("n_"))
    changed = less.withColumn("n_", -F.col("n_")).unionByName(more).groupBy(*one, *version).agg(F.sum("n_").alias("change_"))
    changed = changed.join(counts, version, "left").withColumn("before_", F.coalesce("n_docs", F.lit(0))).withColumn("now_", F.col("before_") + F.col("change_")).drop("n_docs", "change_")
    changed = written(changed, "changed")
    appeared = F.sum((F.col("now_") > 0).cast("long") - (F.col("before_") > 0).cast("long"))
    none = F.lit(0).cast("long")
    leaves = leaf.select(*one, *kind, F.col("own_").alias("own_")).join(judged.groupBy(*one).agg(F.count("*").alias("k_")), one, "left")
    leaves = leaves.join(changed.groupBy(*one).agg(F.count("*").alias("t_"), appeared.alias("more_")), one, "left").join(counts.groupBy(*kind).agg(F.count("*").alias("all_")), kind, "left")
    leaves = leaves.select(*one, *kind, "own_", F.coalesce("k_", none).alias("k_"), F.coalesce("t_", none).alias("t_"), (F.coalesce("all_", none) + F.coalesce("more_", none)).alias("n_versions"))
    leaves = written(leaves, "leaves")

    few = F.col("in_version_") <= F.col("k_") + 1
    first = lambda k, t: (F.col("in_list_") <= F.col(k) + 1) | ((F.col("version_") <= F.col(t) + 2) & (F.col("in_version_") <= F.col(k) + 1))
    top = listed.join(leaves.groupBy(*kind).agg(F.max("k_").alias("most_k_"), F.max("t_").alias("most_t_")), kind).where(first("most_k_", "most_t_")).drop("most_k_", "most_t_")
    columns = [*one, "source_doc", "source_at", "source_start", "source_end", "digest", "n_docs"]
    ahead = leaves.join(top, kind).where(first("k_", "t_")).select(*columns)
    wanted = leaves.select(*one, *kind, F.col("own_").alias("digest")).unionByName(changed.select(*one, *version)).distinct().join(leaves.select(*one, "k_"), one)
    most = leaves.groupBy(*kind).agg(F.max("k_").alias("most_"))
    ahead = ahead.unionByName(wanted.join(listed.join(most, kind).where(F.col("in_version_") <= F.col("most_") + 1), version).where(few).select(*columns))
    ahead = ahead.join(judged.select(*one, "source_doc"), [*one, "source_doc"], "left_anti").unionByName(special.withColumn("n_docs", none).select(*columns)).dropDuplicates([*one, "source_doc", "source_at"])
    ahead = ahead.join(changed.select(*one, "digest", "now_"), [*one, "digest"], "left").withColumn("n_docs", F.coalesce("now_", "n_docs"))
    return ahead.join(leaves.select(*one, "n_versions"), one)
