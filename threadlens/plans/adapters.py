"""Adapters from the driver's test tables to the library's input schemas.

* issues / comments  <- ``conversations`` (turn 0 opens the discussion,
  later turns are its comments, ``turn`` is the position in thread)
* labelled discussions <- ``documents`` joined with ``labels``
* landed API pages   <- the issues adapter rendered as JSON arrays

Everything is derived with DataFrame expressions so the adapters scale with
the tables. The same rules are restated in SQL in ``plans/oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.cues import CueDictionary, with_cue_array

# --- fixed values (adapter conventions) -----------------------------------------
URL_ROOT = "https://issues.example.org/"
EPOCH_DATE = "2024-01-01"
PAGE_SIZE = 10
EMPTY_EVERY = 61
COST_PHRASES = ["", " takes time", " is a manual step", " may break", " is confusing", " wastes time with risk"]
FLAW_EVERY = 40
# Cue words that do occur in the synthetic prose (the default dictionaries are
# built for real issue threads and hardly match invented text).
CORPUS_CUES = [
    ("sequence_words", r"\b(then|after|before|first)\b"),
    ("demonstratives", r"\b(this|that)\b"),
    ("prepositions", r"\b(with|from)\b"),
    ("hostile_words", r"\b(stupid|worthless)\b"),
    ("legal_words", r"\b(license|reserved|public)\b"),
]
# (quality, toxic) -> primary label of the labelled-discussion adapter.
LABEL_RULE = [
    (0, 0, "workaround"),
    (0, 1, "general_complaint"),
    (1, 1, "bug_report"),
    (1, 0, "feature_request"),
]
# ---------------------------------------------------------------------------------

CORPUS = CueDictionary.of("corpus", CORPUS_CUES)
# Rarer words only: the keyword detector of the labelled-discussion adapter, so
# that it misses many workarounds (as keyword rules do) and leaves cues to find.
SIGNAL = CueDictionary.of("signal", [e for e in CORPUS_CUES if e[0] in ("hostile_words", "legal_words")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from threadlens.sources.io import read_table

    return read_table(spark, f"{sf_dir}/{name}.parquet")


def _repository(conv_id) -> F.Column:
    return F.concat(F.lit("chat/"), F.substring(F.md5(conv_id.cast("string")), 1, 1))


def _created_at(conv_id) -> F.Column:
    day = F.date_add(F.lit(EPOCH_DATE).cast("date"), (conv_id / 24).cast("int"))
    hour = F.lpad((conv_id % 24).cast("string"), 2, "0")
    return F.concat(day.cast("string"), F.lit("T"), hour, F.lit(":00:00Z"))


def issues_from_conversations(conversations: DataFrame) -> DataFrame:
    """Turn 0 of each conversation as an issue (collector schema)."""
    counts = conversations.groupBy("conv_id").agg(F.count_if(F.col("turn") >= 1).cast("int").alias("comments_count"))
    first = conversations.filter(F.col("turn") == 0)
    cid = F.col("conv_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    return first.join(counts, "conv_id", "left").select(
        _repository(cid).alias("repository"),
        cid.alias("issue_number"),
        F.substring_index(text, "\n", 1).alias("title"),
        text.alias("body"),
        F.when(F.col("role") == "system", F.lit("closed")).otherwise(F.lit("open")).alias("state"),
        F.lit(None).cast("string").alias("state_reason"),
        F.concat(F.lit("role:"), F.col("role")).alias("labels"),
        F.coalesce(F.col("comments_count"), F.lit(0)).alias("comments_count"),
        _created_at(cid).alias("created_at"),
        _created_at(cid).alias("updated_at"),
        F.lit(None).cast("string").alias("closed_at"),
        F.length(text).alias("body_length"),
        F.concat(F.lit(URL_ROOT), _repository(cid), F.lit("/"), cid.cast("string")).alias("issue_url"),
    )


def comments_from_conversations(conversations: DataFrame) -> DataFrame:
    """Turns >= 1 as comments; ``turn`` is the position in the thread."""
    cid = F.col("conv_id")
    body = F.coalesce(F.col("text"), F.lit(""))
    return conversations.filter(F.col("turn") >= 1).select(
        _repository(cid).alias("repository"),
        cid.alias("issue_number"),
        (cid * 1000 + F.col("turn")).alias("comment_id"),
        F.col("turn").cast("int").alias("position_in_thread"),
        body.alias("comment_body"),
        F.length(body).alias("comment_length"),
        F.concat(F.lit("user-"), F.col("role")).alias("author"),
        F.when(F.col("role") == "assistant", F.lit("MEMBER")).otherwise(F.lit("NONE")).alias("author_association"),
        F.when(F.col("role") == "system", F.lit("Bot")).otherwise(F.lit("User")).alias("user_type"),
        _created_at(cid).alias("created_at"),
        _created_at(cid).alias("updated_at"),
        F.concat(F.lit(URL_ROOT), _repository(cid), F.lit("/"), cid.cast("string"), F.lit("#c"), F.col("turn").cast("string")).alias("comment_url"),
    )


def _line(text: F.Column, i: int) -> F.Column:
    return F.coalesce(F.try_element_at(F.split(text, "\n"), F.lit(i)), F.lit(""))


def labelled_from_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled discussions in the annotation schema (strings, as after a CSV read).

    Workaround rows carry the six evidence fields taken from the document's
    lines (a short document leaves some blank, which validation must flag);
    other rows leave them blank.
    """
    label = F.lit(None).cast("string")
    for q, t, name in LABEL_RULE:
        label = F.when((F.col("quality") == q) & (F.col("toxic") == t), F.lit(name)).otherwise(label)
    # Every EMPTY_EVERY-th discussion lost its text (trainers must drop it).
    text = F.when(F.col("doc_id") % EMPTY_EVERY == 5, F.lit("")).otherwise(F.coalesce(F.col("text"), F.lit("")))
    is_w = label == "workaround"
    fields = ["user_goal", "obstacle", "workaround", "human_cost", "underlying_need", "evidence_quote"]
    # The invented lines never name a cost: append a phrase to most of them.
    phrase = F.element_at(F.array(*[F.lit(x) for x in COST_PHRASES]), (F.col("doc_id") % len(COST_PHRASES) + 1).cast("int"))
    cost = lambda i, f: F.when(_line(text, i) == "", F.lit("")).otherwise(F.concat(_line(text, i), phrase)) if f == "human_cost" else _line(text, i)
    field_cols = [F.when(is_w, cost(i + 2, f)).otherwise(F.lit("")).alias(f) for i, f in enumerate(fields)]
    n = F.col("n_chars")
    return documents.join(labels, "doc_id").select(
        F.format_string("NS-%04d", F.col("doc_id") + 1).alias("annotation_id"),
        F.col("source").alias("repository"),
        F.col("doc_id").alias("issue_number"),
        F.concat(F.lit(URL_ROOT), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("issue_url"),
        _line(text, 1).alias("title"),
        text.alias("thread_text"),
        (n / 1000).cast("long").cast("string").alias("comments_count"),
        F.lit("").alias("heuristic_score"),
        F.lit("").alias("matched_patterns"),
        label.alias("primary_label"),
        F.when(is_w, F.lit("yes")).otherwise(F.lit("no")).alias("has_workaround"),
        *field_cols,
        F.when(n < 1000, F.lit("low")).when(n < 5000, F.lit("medium")).otherwise(F.lit("high")).alias("confidence"),
        F.lit("").alias("annotator_notes"),
    )


def flawed(labelled: DataFrame) -> DataFrame:
    """The labelled table with rows of every kind that validation must flag: a
    repeated id, an unknown label, a wrong and a blank confidence, and yes/no
    answers that contradict the label."""
    nth = lambda k: labelled.filter(F.col("issue_number") % FLAW_EVERY == k)
    renamed = lambda df, mark: df.withColumn("annotation_id", F.concat("annotation_id", F.lit(mark)))
    flip = F.when(F.col("has_workaround") == "yes", F.lit("no")).otherwise(F.lit("yes"))
    return (
        labelled.unionByName(nth(0))
        .unionByName(renamed(nth(1), "-l").withColumn("primary_label", F.lit(" Mystery ")))
        .unionByName(renamed(nth(2), "-c").withColumn("confidence", F.lit("certain")))
        .unionByName(renamed(nth(3), "-b").withColumn("confidence", F.lit(" ")))
        .unionByName(renamed(nth(4), "-y").withColumn("has_workaround", flip))
        .unionByName(renamed(labelled.filter("has_workaround = 'yes'"), "-w").withColumn("has_workaround", F.lit("no")))
    )


def labelled_with_scores(labelled: DataFrame, dictionary: CueDictionary = SIGNAL) -> DataFrame:
    """Fill ``heuristic_score`` / ``matched_patterns`` from a cue dictionary."""
    return with_cue_array(labelled, "thread_text", dictionary, "_c").withColumns(
        {
            "heuristic_score": F.size("_c").cast("string"),
            "matched_patterns": F.array_join("_c", " | "),
        }
    ).drop("_c")


def api_pages_from_conversations(conversations: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Landed issue-list responses: one row per page of up to ``page_size`` items.

    Pages are consecutive issue-number ranges per repository (a bounded
    group), items in issue-number order; system-opened conversations are
    landed as pull requests so the collector must drop them. Every page but a
    repository's last carries a ``rel="next"`` Link header.
    """
    issues = issues_from_conversations(conversations)
    item = F.struct(
        F.col("issue_number").alias("number"),
        F.col("title"),
        F.col("body"),
        F.col("state"),
        F.col("state_reason"),
        F.array(F.struct(F.col("labels").alias("name"))).alias("labels"),
        F.col("comments_count").alias("comments"),
        F.col("created_at"),
        F.col("updated_at"),
        F.col("closed_at"),
        F.col("issue_url").alias("html_url"),
        F.when(F.col("state") == "closed", F.struct(F.col("issue_url").alias("url"))).alias("pull_request"),
        F.struct(F.lit("someone").alias("login")).alias("user"),
        F.lit("NONE").alias("author_association"),
        F.struct(F.col("comments_count").alias("total_count")).alias("reactions"),
    )
    page = (F.col("issue_number") / page_size).cast("long")
    grouped = issues.withColumn("page", page).groupBy("repository", "page").agg(
        F.array_sort(F.collect_list(F.struct(F.col("issue_number"), item.alias("it")))).alias("items"),
        F.max("page").alias("_p"),
    )
    last = issues.withColumn("page", page).groupBy("repository").agg(F.max("page").alias("last_page"))
    base = F.concat(F.lit("https://api.example.org/repos/"), F.col("repository"), F.lit("/issues?page="))
    pages = grouped.join(last, "repository").select(
        F.col("repository"),
        F.concat(base, F.col("page").cast("string")).alias("url"),
        F.lit(200).alias("status"),
        F.when(
            F.col("page") < F.col("last_page"),
            F.concat(
                F.lit("<"), base, (F.col("page") + 1).cast("string"), F.lit('>; rel="next", <'),
                base, F.col("last_page").cast("string"), F.lit('>; rel="last"'),
            ),
        ).alias("link_header"),
        F.to_json(F.transform("items", lambda s: s["it"])).alias("body_json"),
        F.col("page").alias("_page"),
    )
    return _with_faults(pages, "url", F.col("_page")).drop("_page")


def _with_faults(pages: DataFrame, name: str | None, number: F.Column) -> DataFrame:
    """Every third page is also landed twice badly before: once refused (its
    body a list all the same), once as an object instead of a list."""
    bad = pages.filter(number % 3 == 0)
    mark = lambda df, x: df.withColumn(name, F.concat(name, F.lit(x))) if name else df
    refused = mark(bad.withColumn("status", F.lit(403)), "&try=1")
    odd = mark(bad.withColumn("body_json", F.lit('{"message": "try again"}')), "&try=2")
    return pages.unionByName(refused).unionByName(odd)


COMMENT_PAGE_SIZE = 3


def comment_pages_from_conversations(conversations: DataFrame, page_size: int = COMMENT_PAGE_SIZE) -> DataFrame:
    """Landed comment-list responses: one row per (discussion, page) of up to
    ``page_size`` comments in thread order, with the page number."""
    c = comments_from_conversations(conversations)
    item = F.struct(
        F.col("comment_id").alias("id"),
        F.col("comment_body").alias("body"),
        F.struct(F.col("author").alias("login"), F.col("user_type").alias("type")).alias("user"),
        F.col("author_association"),
        F.col("created_at"),
        F.col("updated_at"),
        F.col("comment_url").alias("html_url"),
    )
    page = ((F.col("position_in_thread") - 1) / page_size).cast("int") + 1
    grouped = c.withColumn("page_number", page).groupBy("repository", "issue_number", "page_number").agg(
        F.array_sort(F.collect_list(F.struct(F.col("position_in_thread"), item.alias("it")))).alias("items")
    )
    pages = grouped.select(
        "repository", "issue_number", "page_number", F.lit(page_size).alias("page_size"), F.lit(200).alias("status"),
        F.to_json(F.transform("items", lambda x: x["it"])).alias("body_json"),
    )
    return _with_faults(pages, None, F.col("page_number"))
