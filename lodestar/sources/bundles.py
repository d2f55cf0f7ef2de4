"""Review bundles, trajectories and mixed folders as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names under which a review row may carry a field.
ALIASES = {
    "subject": ("subject", "source", "s", "head"),
    "predicate": ("predicate", "relation", "p"),
    "object": ("object", "target", "o", "tail"),
    "verdict": ("verdict", "expert_verdict", "label"),
    "assertion_id": ("assertion_id", "id", "edge_id"),
    "evidence": ("evidence", "evidence_text", "evidence_payload_full"),
}
#: Fields that may hold the rows of a bundle.
CONTAINERS = ("assertions", "rows", "triplets", "edges")


def first_of(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of these columns that exists and is not blank."""
    own = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def aliased(rows: DataFrame) -> DataFrame:
    """Review rows with the canonical columns, whatever theirs are called."""
    return rows.select(*(first_of(rows, names).alias(c) for c, names in ALIASES.items()))


def review_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows, or the rows in the first container of a JSON document."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = spark.read.option("multiLine", True).json(path)
    for name in CONTAINERS:
        if name in rows.columns and isinstance(rows.schema[name].dataType, T.ArrayType):
            return rows.select(F.explode(name).alias("r")).select("r.*")
    return rows


STEP = "struct<step_id:int,claim:string,inference:string,next_question:string,sources:array<struct<type:string,source:string,page:int,locator:string,snippet_or_summary:string>>>"
LINK = "struct<from_step_id:int,to_step_id:int,from_step:int,to_step:int,predicate:string,label:string,directionality:string>"
TRAJECTORY = f"submission_id string, topic string, domain string, cutoff_year int, papers array<struct<id:string,year:int,title:string>>, steps array<{STEP}>, edges array<{LINK}>"


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAJECTORY).option("multiLine", True).json(path)


def trajectory_steps(docs: DataFrame) -> DataFrame:
    return docs.select("submission_id", F.posexplode("steps").alias("pos", "s")).select("submission_id", "pos", "s.step_id", "s.claim", "s.inference", "s.next_question")


def trajectory_sources(docs: DataFrame) -> DataFrame:
    steps = docs.select("submission_id", F.explode("steps").alias("s"))
    return steps.select("submission_id", "s.step_id", F.posexplode("s.sources").alias("pos", "x")).select("submission_id", "step_id", "pos", "x.*")


def trajectory_edges(docs: DataFrame, both_spellings: bool = False) -> DataFrame:
    """(submission_id, source, target, predicate): edges between steps.

    Two-way edges get a reversed twin.  A document without edges links its
    consecutive steps by leads_to.  Only from_step_id and to_step_id are read
    unless ``both_spellings`` also admits from_step and to_step.
    """
    e = docs.select("submission_id", F.explode("edges").alias("e")).select("submission_id", "e.*")
    source, target, name = F.col("from_step_id"), F.col("to_step_id"), F.col("predicate")
    if both_spellings:
        source, target, name = F.coalesce(source, "from_step"), F.coalesce(target, "to_step"), F.coalesce(name, "label")
    forward = F.struct(source.alias("source"), target.alias("target"))
    back = F.struct(target.alias("source"), source.alias("target"))
    ways = F.when(F.lower("directionality").isin("bidirectional", "simultaneous"), F.array(forward, back)).otherwise(F.array(forward))
    given = e.select("submission_id", F.explode(ways).alias("w"), F.coalesce(name, F.lit("leads_to")).alias("predicate")).select("submission_id", "w.source", "w.target", "predicate").where("source IS NOT NULL AND target IS NOT NULL")
    ids = F.transform("steps", lambda s: s["step_id"])
    chain = F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    bare = docs.where(F.coalesce(F.size("edges"), F.lit(0)) <= 0).select("submission_id", F.explode(chain).alias("w")).select("submission_id", "w.source", "w.target", F.lit("leads_to").alias("predicate"))
    return given.unionByName(bare)


def classified_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, length): manifest, image, pdf or other files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.lower("path")
    return files.withColumn("kind", F.when(name.rlike(r"manifest[^/]*\.json$"), "manifest").when(name.rlike(r"\.(png|jpe?g|webp|gif|tiff?)$"), "image").when(name.endswith(".pdf"), "pdf").otherwise("other"))


def tei_text(xml: Column) -> Column:
    """Titles, then abstracts, then paragraphs of a TEI document, blanks collapsed; empty if it cannot be read."""
    found = F.concat(F.xpath(xml, F.lit("//*[local-name()='title']/text()")), F.xpath(xml, F.lit("//*[local-name()='abstract']//text()")), F.xpath(xml, F.lit("//*[local-name()='p']/text()")))
    return F.trim(F.regexp_replace(F.array_join(found, " "), r"\s+", " "))


#: A folder with one of these is a bundle, into which a mixed scan does not look.
BUNDLE_MARKS = ("edge_reviews.json", "review_state_latest.json", "temporal_corrections.json", "task2_notebook_manifest.json")


def review_inputs(files: DataFrame) -> DataFrame:
    """(path, kind): trajectories (.yaml, .yml, .json) and bundles among listed files, a bundle once and nothing inside it.

    ``files``: path.
    """
    rows = files.select("path", F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    bundles = rows.where(F.col("name").isin(*BUNDLE_MARKS)).select("folder").distinct()
    outer = bundles.select(F.col("folder").alias("above"))
    # A bundle inside another one is a part of it.
    tops = bundles.join(outer, F.col("folder").startswith(F.concat("above", F.lit("/"))), "left_anti")
    loose = rows.join(F.broadcast(tops.select(F.col("folder").alias("top"))), (F.col("folder") == F.col("top")) | F.col("folder").startswith(F.concat("top", F.lit("/"))), "left_anti")
    loose = loose.where(F.lower("name").rlike(r"\.(ya?ml|json)$")).select("path", F.lit("trajectory").alias("kind"))
    archives = rows.where(F.lower("name").rlike(r"\.zip$")).select("path", F.lit("bundle").alias("kind"))
    return loose.unionByName(tops.select(F.col("folder").alias("path"), F.lit("bundle").alias("kind"))).unionByName(archives).distinct()


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, content): the files in the ZIP archives of a binaryFile table; other files, and archives that cannot be read, give nothing."""
    import io
    import zipfile

    import pandas as pd

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        out += [(path, m.filename, archive.read(m)) for m in archive.infolist() if not m.is_dir()]
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["path", "member", "content"])

    return files.where(F.lower("path").endswith(".zip")).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def yaml_documents(files: DataFrame) -> DataFrame:
    """(path, json): YAML or JSON documents of a table (path, content) as JSON; what cannot be read is null."""
    import json

    import pandas as pd

    def run(batches):
        try:
            import yaml
        except ImportError:
            yaml = None

        def read(content):
            text = bytes(content).decode("utf-8", "replace")
            try:
                return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True)
            except ValueError:
                if yaml is None:
                    return None
            try:
                return json.dumps(yaml.safe_load(text), ensure_ascii=False, sort_keys=True, default=str)
            except yaml.YAMLError:
                return None

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "json": [read(c) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, json string")


def asset_aliases(records: DataFrame) -> DataFrame:
    """(alias, record_id, pos): each name under which an asset may be asked for: its paper, its source and any further ones, canonical and once.

    ``records``: record_id, pos, paper_id, source, aliases (an array).
    """
    from lodestar.functions import keys as K
    from lodestar.functions import text as X

    def key(x: Column) -> Column:
        own = F.lower(F.trim(x))
        return F.coalesce(F.nullif(F.concat(F.lit("doi:"), F.nullif(K.doi(own), F.lit(""))), F.lit("")), F.when(own.rlike("^https?://"), F.regexp_replace(K.url_canonical(own), r"\.pdf$", "")), F.nullif(X.norm(own), F.lit("")))

    names = F.array_distinct(F.array_compact(F.transform(F.concat(F.array("paper_id", "source"), F.coalesce("aliases", F.array().cast("array<string>"))), key)))
    return records.select(F.explode(names).alias("alias"), "record_id", "pos")


def page_assets(pages: DataFrame) -> DataFrame:
    """Pages (paper_id, page, text, image_path, vlm_caption, tables_md, equations_md) as assets with one summary line."""
    part = lambda name, column: F.concat(F.lit(f"{name}="), F.nullif(F.trim(column), F.lit("")))
    summary = F.concat_ws(" | ", part("caption", "vlm_caption"), part("text", "text"), part("tables", "tables_md"), part("equations", "equations_md"))
    return pages.select(F.concat_ws(":", "paper_id", F.concat(F.lit("page"), F.col("page").cast("string"))).alias("record_id"), "paper_id", "page", F.lit("page").alias("modality"), F.col("image_path").isNotNull().alias("has_image"), summary.alias("summary"))


def edge_review_assets(reviews: DataFrame) -> DataFrame:
    """Reviewed edges (edge_id, paper_id, page, figure_or_table, snippet, image_path) as assets."""
    modality = F.when(F.lower("figure_or_table").contains("tab"), "table").when(F.lower("figure_or_table").contains("fig"), "figure").otherwise("text")
    return reviews.select(F.col("edge_id").alias("record_id"), "paper_id", F.col("page").cast("int").alias("page"), modality.alias("modality"), F.col("image_path").isNotNull().alias("has_image"), F.col("snippet").alias("summary"))


def text_native(pages: DataFrame, probe: int = 4, letters: int = 400, share: float = 0.75) -> DataFrame:
    """(path, native): whether a document's first ``probe`` pages have text, ``letters`` or more on a ``share`` of them, so that no recognition is needed."""
    first = pages.where(F.col("page") <= probe).groupBy("path").agg((F.count_if(F.length(F.trim("text")) >= letters) / F.count(F.lit(1))).alias("covered"))
    return first.select("path", (F.col("covered") >= share).alias("native"))


def reference_graph(docs: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges and triplets of trajectories: steps, their sources and the links between steps, as (submission_id, ...).

    Nodes: step:i and source:i:j; edges: links between steps (a two-way one
    twice) and from steps to their sources; triplets: every link between steps.
    """
    steps, sources, links = trajectory_steps(docs), trajectory_sources(docs), trajectory_edges(docs)
    name = lambda c: F.concat(F.lit("step:"), F.col(c).cast("string"))
    place = F.concat(F.lit("source:"), F.col("step_id").cast("string"), F.lit(":"), (F.col("pos") + 1).cast("string"))
    nodes = steps.select("submission_id", name("step_id").alias("node"), F.lit("trajectory_step").alias("type"), F.col("claim").alias("label")).unionByName(sources.select("submission_id", place.alias("node"), F.lit("source").alias("type"), F.trim(F.concat_ws(" ", "source", F.coalesce("locator", F.col("page").cast("string")))).alias("label")))
    own = links.select("submission_id", name("source").alias("source"), name("target").alias("target"), "predicate")
    cited = sources.select("submission_id", name("step_id").alias("source"), place.alias("target"), F.lit("supported_by").alias("predicate"))
    said = steps.select("submission_id", name("step_id").alias("node"), "claim")
    triplets = own.join(said.select("submission_id", F.col("node").alias("source"), F.col("claim").alias("subject")), ["submission_id", "source"]).join(said.select("submission_id", F.col("node").alias("target"), F.col("claim").alias("object")), ["submission_id", "target"])
    return {"nodes": nodes, "edges": own.unionByName(cited), "triplets": triplets.select("submission_id", "subject", "predicate", "object")}
