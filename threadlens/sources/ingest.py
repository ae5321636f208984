"""Landed issue-tracker API payloads -> issues, comments, crawl frontier.

HTTP is out of scope: a fetcher lands one row per response
``(repository, url, status, link_header, body_json)``; everything after that is
DataFrame work. Each issue is first split out as raw JSON text so key presence
(``pull_request``) and non-object label entries are judged exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.text import strip_ws, text_length
from threadlens.operators.sampling import sequence_number
from threadlens.sources.schemas import require_columns

# --- fixed values ---------------------------------------------------------------
NEXT_REL = 'rel="next"'
LABEL_SEPARATOR = " | "
COMMENTS_TEXT_SEPARATOR = "\n\n"
DEFAULT_ISSUE_LIMIT = 100
DEFAULT_ISSUES_PER_REPO = 175
DEFAULT_RICHEST_ISSUES = 25
# ---------------------------------------------------------------------------------

ISSUE_JSON_SCHEMA = (
    "struct<number:bigint,title:string,body:string,state:string,state_reason:string,"
    "labels:array<string>,comments:bigint,created_at:string,updated_at:string,closed_at:string,"
    "html_url:string,user:struct<login:string>,author_association:string,"
    "reactions:struct<total_count:bigint>,comments_url:string>"
)
COMMENT_JSON_SCHEMA = (
    "struct<id:bigint,body:string,user:struct<login:string,type:string>,author_association:string,"
    "created_at:string,updated_at:string,html_url:string>"
)


def parse_next_link(link: Column | str, first_param_only: bool = False) -> Column:
    """URL of the section whose parameters include ``rel="next"``; else null.

    ``first_param_only`` reproduces the stricter variant that only inspects the
    first parameter of each section.
    """
    c = F.col(link) if isinstance(link, str) else link
    sections = F.split(c, ",")
    parts = F.transform(sections, lambda s: F.transform(F.split(s, ";"), lambda p: strip_ws(p)))
    if first_param_only:
        rel_ok = lambda ps: F.get(ps, 1) == F.lit(NEXT_REL)
    else:
        rel_ok = lambda ps: F.array_contains(F.slice(ps, 2, F.greatest(F.size(ps) - 1, F.lit(1))), NEXT_REL)
    hits = F.filter(parts, lambda ps: (F.size(ps) >= 2) & rel_ok(ps))
    raw = F.get(F.get(hits, 0), 0)
    url = F.regexp_replace(strip_ws(raw), r"^[<>]+|[<>]+$", "")
    return F.when(c.isNull() | (c == "") | raw.isNull(), F.lit(None).cast("string")).otherwise(url)


def payload_items(pages: DataFrame) -> DataFrame:
    """I10 split: valid list payloads exploded to one raw JSON item per row.

    Adds ``page_index`` (0-based position of the item on its page). Pages that
    ``quarantine`` names are left out.
    """
    require_columns(pages, ["repository", "url", "body_json"], "Landed responses")
    valid = pages.filter(_fault(pages).isNull())
    return valid.select("repository", "url", *_landing(pages), F.posexplode(_payload()).alias("page_index", "raw"))


def _landing(pages: DataFrame) -> list[str]:
    """The time a page landed at, where the source gives it (streams do)."""
    return [c for c in ("landed_at",) if c in pages.columns]


def _payload() -> Column:
    return F.from_json(F.col("body_json"), "array<string>")


def _fault(pages: DataFrame) -> Column:
    """Why a landed page can't be read, null if it can. A null status is a fault."""
    is_list = F.col("body_json").isNotNull() & F.trim(F.col("body_json")).startswith("[") & _payload().isNotNull()
    status_ok = F.coalesce(F.col("status") == 200, F.lit(False)) if "status" in pages.columns else F.lit(True)
    return (
        F.when(~status_ok, F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("unknown"))))
        .when(~is_list, F.lit("unexpected response format"))
    )


def quarantine(pages: DataFrame) -> DataFrame:
    """Issue or comment pages that are not a JSON list (or not HTTP 200), with a reason."""
    return pages.withColumn("reason", _fault(pages)).filter(F.col("reason").isNotNull())


def is_pull_request(raw: Column | str = "raw") -> Column:
    """The item carries a ``pull_request`` key (value irrelevant)."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.array_contains(F.json_object_keys(c), "pull_request"), F.lit(False))


def _label_names(labels: Column) -> Column:
    """Names of object entries only (other entries are skipped)."""
    objs = F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda e: F.ltrim(e).startswith("{"))
    return F.transform(objs, lambda e: F.coalesce(F.get_json_object(e, "$.name"), F.lit("")))


def flatten_issues(pages: DataFrame, drop_pull_requests: bool = True) -> DataFrame:
    """I1 (+ I2): one collector-schema row per issue item."""
    items = payload_items(pages)
    if drop_pull_requests:
        items = items.filter(~is_pull_request("raw"))
    it = F.from_json("raw", ISSUE_JSON_SCHEMA)
    items = items.withColumn("it", it)
    body = F.coalesce(F.col("it.body"), F.lit(""))
    return items.select(
        "repository",
        F.col("it.number").alias("issue_number"),
        F.coalesce(F.col("it.title"), F.lit("")).alias("title"),
        body.alias("body"),
        F.col("it.state").alias("state"),
        F.col("it.state_reason").alias("state_reason"),
        F.array_join(_label_names(F.col("it.labels")), LABEL_SEPARATOR).alias("labels"),
        F.coalesce(F.col("it.comments"), F.lit(0)).cast("int").alias("comments_count"),
        F.col("it.created_at").alias("created_at"),
        F.col("it.updated_at").alias("updated_at"),
        F.col("it.closed_at").alias("closed_at"),
        text_length(body).cast("int").alias("body_length"),
        F.col("it.html_url").alias("issue_url"),
        *_landing(pages),
    )


def newest_per_repository(issues: DataFrame, n: int = DEFAULT_ISSUE_LIMIT, by: str = "created_at") -> DataFrame:
    """Newest ``n`` issues per repository (``by`` desc, number desc).

    ``row_number() <= n`` plans as a WindowGroupLimit, so every map task keeps
    at most n rows per repository before the shuffle — a hot repository
    cannot flood one task.
    """
    if n < 1:
        raise ValueError(f"n has to be positive, not {n}")
    w = Window.partitionBy("repository").orderBy(F.desc_nulls_last(by), F.desc("issue_number"))
    return issues.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def flatten_comments(pages: DataFrame) -> DataFrame:
    """I4: comment items of landed comment pages -> flat rows.

    Comment pages carry ``issue_number`` next to ``repository``; the position
    is the item's rank on its page plus the rows of earlier pages of the same
    issue (``page_number`` column, 1-based, full pages of ``page_size``). Pages
    that ``quarantine`` names are left out.
    """
    require_columns(pages, ["repository", "issue_number", "body_json"], "Landed comment responses")
    cols = ["repository", "issue_number"] + (["page_number", "page_size"] if "page_number" in pages.columns else [])
    items = pages.filter(_fault(pages).isNull()).select(*cols, F.posexplode(_payload()).alias("page_index", "raw"))
    c = F.from_json("raw", COMMENT_JSON_SCHEMA)
    items = items.withColumn("c", c)
    body = F.coalesce(F.col("c.body"), F.lit(""))
    out = items.select(
        "repository",
        "issue_number",
        F.col("c.id").alias("comment_id"),
        *([((F.col("page_number") - 1) * F.col("page_size") + F.col("page_index") + 1).cast("int").alias("position_in_thread")] if "page_number" in pages.columns else []),
        body.alias("comment_body"),
        text_length(body).cast("int").alias("comment_length"),
        F.col("c.user.login").alias("author"),
        F.col("c.author_association").alias("author_association"),
        F.col("c.user.type").alias("user_type"),
        F.col("c.created_at").alias("created_at"),
        F.col("c.updated_at").alias("updated_at"),
        F.col("c.html_url").alias("comment_url"),
    )
    return out


def comment_positions(comments: DataFrame) -> DataFrame:
    """1-based position per discussion, created ascending, id breaks ties.

    Keys and dates alone are numbered by range partitions, so a discussion of
    any length spreads over tasks; the positions then join the comments.
    """
    key = ["repository", "issue_number"]
    narrow = comments.select(*key, "created_at", "comment_id").distinct()
    order = [F.asc_nulls_last("created_at"), F.asc("comment_id")]
    numbered = sequence_number(narrow, order, key, out="position_in_thread")
    same = [comments[c].eqNullSafe(numbered[c]) for c in [*key, "created_at", "comment_id"]]
    rest = [comments[c] for c in comments.columns if c != "position_in_thread"]
    return comments.join(numbered, same).select(*rest, numbered["position_in_thread"].cast("int").alias("position_in_thread"))


def richest_issues(issues: DataFrame, max_issues: int = DEFAULT_RICHEST_ISSUES) -> DataFrame:
    """Discussed issues (count > 0, null as 0), most comments first, top ``max_issues``."""
    require_columns(issues, ["issue_number", "comments_count"], "Issues file")
    cc = F.coalesce(F.col("comments_count").cast("long"), F.lit(0))
    elig = issues.withColumn("comments_count", cc).filter(cc > 0)
    order = [F.desc("comments_count"), F.asc("issue_number")]
    if "repository" in issues.columns:  # an issue number names an issue of one repository only
        order.append(F.asc("repository"))
    return elig.orderBy(*order).limit(max_issues)


def cap_comments(comments: DataFrame, cap: int) -> DataFrame:
    """First ``cap`` comments per discussion by position (WindowGroupLimit)."""
    w = Window.partitionBy("repository", "issue_number").orderBy("position_in_thread", "comment_id")
    return comments.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def nested_issues(pages: DataFrame, comments: DataFrame | None = None, include_comments: bool = True, cap: int | None = None) -> DataFrame:
    """I8 + I9: one nested record per issue with its comments array (all of them unless ``cap`` is given).

    Comments are attached only when requested and the issue has comments; the
    text joins stripped non-blank bodies by a blank line, in thread order.
    """
    items = payload_items(pages).filter(~is_pull_request("raw")).withColumn("it", F.from_json("raw", ISSUE_JSON_SCHEMA))
    issues = items.select(
        F.col("repository").alias("repo"),
        F.col("it.number").alias("issue_number"),
        F.col("it.state").alias("state"),
        F.coalesce(F.col("it.title"), F.lit("")).alias("title"),
        F.coalesce(F.col("it.body"), F.lit("")).alias("body"),
        _label_names(F.col("it.labels")).alias("labels"),
        F.col("it.user.login").alias("author"),
        F.col("it.author_association").alias("author_association"),
        F.col("it.created_at").alias("created_at"),
        F.col("it.updated_at").alias("updated_at"),
        F.col("it.closed_at").alias("closed_at"),
        F.coalesce(F.col("it.comments"), F.lit(0)).alias("comment_count"),
        F.coalesce(F.col("it.reactions.total_count"), F.lit(0)).alias("reaction_count"),
        F.col("it.html_url").alias("html_url"),
    )
    empty = F.array().cast(
        "array<struct<position_in_thread:int,comment_id:bigint,author:string,author_association:string,"
        "created_at:string,updated_at:string,body:string,html_url:string>>"
    )
    if not include_comments or comments is None:
        return issues.withColumns({"comments_text": F.lit(""), "comments": empty})
    capped = comments if cap is None else cap_comments(comments, cap)
    author = F.col("author").cast("string") if "author" in comments.columns else F.lit(None).cast("string")
    grouped = capped.groupBy(F.col("repository").alias("repo"), "issue_number").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("position_in_thread").cast("int").alias("position_in_thread"),
                    F.col("comment_id").cast("bigint").alias("comment_id"),
                    author.alias("author"),
                    F.col("author_association").cast("string").alias("author_association"),
                    F.col("created_at").cast("string").alias("created_at"),
                    F.col("updated_at").cast("string").alias("updated_at"),
                    F.coalesce(F.col("comment_body"), F.lit("")).alias("body"),
                    F.col("comment_url").cast("string").alias("html_url"),
                )
            )
        ).alias("_comments")
    )
    joined = issues.join(grouped, ["repo", "issue_number"], "left")
    has = F.col("comment_count") > 0
    comm = F.when(has, F.coalesce(F.col("_comments"), empty)).otherwise(empty)
    text = F.array_join(
        F.filter(F.transform(comm, lambda s: strip_ws(s["body"])), lambda b: b != ""), COMMENTS_TEXT_SEPARATOR
    )
    return joined.withColumns({"comments": comm}).withColumn("comments_text", text).drop("_comments")


def crawl_links(pages: DataFrame, first_param_only: bool = False) -> DataFrame:
    """Next-page URL of each landed response."""
    return pages.select("repository", "url", parse_next_link("link_header", first_param_only).alias("next_url"))


def crawl_frontier(pages: DataFrame) -> DataFrame:
    """Next-page URLs not landed yet (anti-join on the fetched URLs)."""
    links = crawl_links(pages).filter(F.col("next_url").isNotNull())
    fetched = pages.select(F.col("url").alias("next_url"))
    return links.join(fetched, "next_url", "left_anti").select("repository", "next_url").distinct()
