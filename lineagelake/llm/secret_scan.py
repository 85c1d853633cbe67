"""Secret scanning with corpus-wide ownership frequency, in SQL functions only.

Spans come from two scans of each kind's pattern: all matches, and the text between
them; running sums of their lengths (a window per text and kind) give the places.  Kinds of ``BASE`` always stay.  Kinds of
``SHAPES`` are candidates by shape alone; whether such a value is a live-looking
credential is decided by the corpus: the hash of each value is counted over distinct
repositories and distinct owners.  Values that several owners hold, or that stand in more than ``MAX_REPOS``
repositories of their one owner, are widely copied examples; only owner-specific ones become spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_name, materialize, with_row_ids

#: Fixed values. Kind -> (pattern, group of the value, least length of the value).
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}+", 0, 24),
}
SHAPES = {
    "github": (r"gh[pousr]_[A-Za-z0-9]{20,}+", 0, 24),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}+", 0, 15),
    "stripe": (r"[rs]k_(?:live|test)_[A-Za-z0-9]{10,}+", 0, 18),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 30),
    "google": (r"AIza[A-Za-z0-9_-]{30,}+", 0, 34),
    "account": (r"[0-9]{13,}+", 0, 13),
    "login": (r"[a-z]+://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@", 0, 9),
}
#: Kinds in the order in which spans at one place are listed.
KINDS = [*BASE, *SHAPES]
#: A value of more distinct owners, or of more distinct repositories an owner, is widely copied.
MAX_OWNERS, MAX_REPOS = 1, 1000
#: Characters of a block of text that redaction cuts pieces from.
BLOCK = 8192
SPAN = "struct<start:int,rank:int,end:int,hash:string>"


def _literal(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _matches(kind: str) -> list[Column]:
    """Whole matches, values and the text before each match (one more: what follows the last)."""
    pattern, group, _ = (BASE | SHAPES)[kind]
    p, none = _literal(pattern), "CAST(array() AS array<string>)"
    hit = f"IF(hit_{kind}, "
    return [
        F.expr(f"{hit}regexp_extract_all(text, '{p}', 0), {none})").alias(f"whole_{kind}"),
        F.expr(f"{hit}regexp_extract_all(text, '{p}', {group}), {none})").alias(f"value_{kind}"),
        F.expr(f"{hit}split(text, '{p}', -1), {none})").alias(f"gap_{kind}"),
    ]


def _hits(kind: str) -> Column:
    """array<HIT> of a kind's matches, leftmost and non-overlapping; no hash where the value is too short."""
    least, rank = (BASE | SHAPES)[kind][2], KINDS.index(kind)
    zipped = f"filter(arrays_zip(whole_{kind}, value_{kind}, gap_{kind}), x -> x.whole_{kind} IS NOT NULL)"
    return F.expr(f"""transform({zipped}, (x, i) -> named_struct('rank', {rank}, 'i', i, 'before', char_length(x.gap_{kind}), 'whole', char_length(x.whole_{kind}),
          'hash', IF(char_length(x.value_{kind}) < {least}, NULL, sha2(x.value_{kind}, 256))))""")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(row, doc_id, owner, repo, hits) of every row; ``row`` numbers the rows and ``hits`` is an array
    of matches: kind, number, the characters since the last match and its own, and the hash of its
    value, never the value."""
    carried = ["doc_id", "owner", "repo"]
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"))
    hits = text.select(*carried, "text", *(F.expr(f"text RLIKE '{_literal((BASE | SHAPES)[k][0])}'").alias(f"hit_{k}") for k in KINDS))
    matches = hits.select(*carried, *(c for k in KINDS for c in _matches(k)))
    return matches.select(*carried, F.concat(*map(_hits, KINDS)).alias("hits"), F.monotonically_increasing_id().alias("row"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repos): distinct owners and repositories of each candidate value.

    A null owner or repository counts as none; partial distinct sums go to the shuffle, so a
    value that a third of all rows holds is spread over its owners and repositories.
    """
    held = found.select(F.explode("hits").alias("s"), "owner", "repo").select(F.col("s.hash").alias("hash"), "owner", "repo").where("hash IS NOT NULL")
    owners = held.select("hash", "owner").distinct().groupBy("hash").agg(F.count("owner").alias("owners"))
    repos = held.select("hash", "repo").distinct().groupBy("hash").agg(F.count("repo").alias("repos"))
    return owners.join(repos, "hash")


def _listed(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.rank + 1), ':', x.start, ':', x.end)), ',')")


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, **columns: str) -> DataFrame:
    """Every row's spans: doc_id, n_assign, n_access, n_hex, base_spans, spans (text:
    kind:start:end by start, then kind; code points, end exclusive), all_spans (array of
    start, rank, end, hash), n_copied and n_owned (spans whose value is widely copied, or not), and
    most_owners and most_repos (of any of its values, 0 without).

    A value is widely copied if more than ``max_owners`` hold it, or if its repositories are more than ``max_repos`` for
    each of its owners (one, if its owners are all null).  Null and empty texts have no spans.  Repeated rows give
    repeated results and count once; other columns are not read.  Spans of several kinds at one place follow in the order of ``KINDS``.
    A text's spans are put in order by themselves, so work grows with their number.
    """
    found = materialize(find(docs, **columns), "secrets-found")
    few = F.col("repos") <= max_repos * F.greatest("owners", F.lit(1))
    verdict = ownership(found).select("hash", "owners", "repos", ((F.col("owners") <= max_owners) & few).alias("owned"))
    so_far = Window.partitionBy("row", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = found.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("end", F.sum(F.col("before") + F.col("whole")).over(so_far).cast("int")).where("hash IS NOT NULL")
    span = F.struct((F.col("end") - F.col("whole")).alias("start"), "rank", "end", "hash")
    stays = F.col("rank") < len(BASE)
    judged = each.join(verdict, "hash").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(stays, span))).alias("base"),
        F.array_sort(F.collect_list(F.when(stays | F.col("owned"), span))).alias("all_spans"),
        *(F.count_if(F.col("rank") == KINDS.index(k)).alias(f"n_{k}") for k in BASE),
        F.count_if(~F.col("owned")).alias("n_copied"),
        F.count_if("owned").alias("n_owned"),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    out = found.select("row", "doc_id").join(judged, "row", "left")
    for c in ("base", "all_spans"):
        out = out.withColumn(c, F.coalesce(c, F.expr(f"CAST(array() AS array<{SPAN}>)")))
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("row", "doc_id", *(count(f"n_{k}") for k in BASE), _listed("base").alias("base_spans"), _listed("all_spans").alias("spans"), "all_spans", *map(count, ("n_copied", "n_owned", "most_owners", "most_repos")))


def with_digests(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_copied", "n_owned", "most_owners", "most_repos")


def redact(docs: DataFrame) -> DataFrame:
    """The rows with every span's characters replaced by ``[SECRET]``; ``n_chars`` follows
    where the table has it and something was replaced.  Overlapping spans are replaced once, as their
    union; null and empty texts and repeated rows stay as they are."""
    row, cuts, last = fresh_name(docs, "row"), fresh_name(docs, "cuts"), fresh_name(docs, "last")
    rows = with_row_ids(docs, row)
    spans = scan(rows.select(row, "text", "source"), id_col=row, repo_col=row).select(F.col("doc_id").alias("r"), F.explode("all_spans").alias("s")).select("r", "s.start", "s.rank", "s.end")
    before = F.coalesce(F.max("end").over(Window.partitionBy("r").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the clear text before each run of overlapping spans, and where the last run ends
    runs = spans.withColumn("from", before).groupBy("r").agg(F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("from"), F.struct("from", "start")))).alias(cuts), F.max("end").alias(last))
    # the text in blocks, so that a piece is found without reading the text from its start
    at = lambda side: f"least(greatest({side} - k * {BLOCK}, 0), {BLOCK})"
    piece = f"array_join(transform(sequence(x.from div {BLOCK}, x.start div {BLOCK}), k -> substring(b[k], {at('x.from')} + 1, {at('x.start')} - {at('x.from')})), '')"
    blocks = f"transform(sequence(0, char_length(text) div {BLOCK}), k -> substring(text, k * {BLOCK} + 1, {BLOCK}))"
    clean = F.expr(f"transform(array({blocks}), b -> array_join(transform(concat({cuts}, array(named_struct('from', {last}, 'start', char_length(text)))), x -> {piece}), '[SECRET]'))[0]")
    out = rows.join(runs.withColumnRenamed("r", row), row, "left").withColumn("text", F.when(F.col(last).isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(last).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
