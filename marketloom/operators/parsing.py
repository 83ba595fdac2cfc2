"""Picks read out of landed report texts: blocks under headers, summary tables, and JSON contracts.

A text is cut and read by column expressions in the task that holds it, in one pass over the
table. What leaves the task is a narrow row a pick; the only shuffles bring a ticker's block and
table row of one text together, or a contract's ids and their tickers.

Texts that are null, blank or hold no pick give no rows in :func:`picks` and one row with its
error in :func:`outcomes`. Strings that are empty are NULL. Ids are taken as they are; texts that
share an id are told apart by their digest, and equal texts under one id give their picks once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as fn

SPACE = " \t\r\f\x0b"

# Forms of headers, labels of fields and names of table columns.
TICKER = r"STOCK_[A-Z]+|[A-Z]{1,6}"
NUMBERED = rf"\*\*(\d+)\.[ \t]+({TICKER})(?:[ \t]*[—–-][ \t]*[^\n]+?)?\*\*"
NAMED = rf"^###[ \t]+({TICKER})(?:[ \t]*[—–-].*)?$"
LABELS = {
    "setup": "Setup",
    "conviction": "Conviction",
    "entry": r"Entry\s*(?:zone|range)?",
    "stop": "Stop",
    "both_targets": r"T1\s*/\s*T2",
    "target1": r"(?:T1|Target\s*1)",
    "target2": r"(?:T2|Target\s*2)",
    "risk_reward": "R/R",
    "size": "(?:Size|Position)",
    "hold_period": r"Hold\s*(?:period|horizon)",
    "accum_distrib": "(?:A/D|Accum|Accumulation)",
    "disqualifier_reason": r"disqualifier[\s_]*reason",
}
RISK = r"(?i)Risk[%\s]*(?:\([^)]*\)\s*:?\s*)?\*?\*?([\d.]+)\s*%"
INLINE_RATIO = r"([\d.]+)\s*:\s*1"
COLUMNS = {
    "ticker": ["ticker", "id", "stock_id", "symbol"],
    "rank": ["rank", "#", "no."],
    "setup": ["setup", "pattern", "setup_type"],
    "entry": ["entry_zone", "entry", "entry_range"],
    "stop": ["stop", "stop_price"],
    "risk": ["riskpct", "risk_pct", "risk"],
    "target1": ["t1", "target_1", "target1", "t1_(3m)"],
    "target2": ["t2", "target_2", "target2", "t2_(6m)", "t2_(12m)"],
    "risk_reward": ["r/r", "rr", "risk_reward", "r:r", "r/r_(t1)"],
    "size": ["size", "position_size", "position", "sizepct"],
    "conviction": ["conviction"],
    "hold_period": ["hold", "hold_period"],
    "accum_distrib": ["accum/distrib", "a/d", "accum", "accumulation"],
}

#: A pick's fields; those of FILLED are taken from the table where its block lacks them.
FILLED = ["setup", "conviction", "entry_low", "entry_high", "stop_price", "target1", "target2", "risk_pct", "risk_reward", "position_size"]
FIELDS = [*FILLED, "hold_period", "accum_distrib", "disqualified", "disqualifier_reason"]


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def _said(c: Column) -> Column:
    """A value without the marks that end it; NULL where nothing is left."""
    kept = _trim(F.rtrim(_trim(c), F.lit("*|")))
    return F.when(kept != "", kept)


def _size(c: Column) -> Column:
    up = F.upper(_trim(c))
    bare = F.when(F.instr(up, "(") > 1, _trim(F.substring_index(up, "(", 1))).otherwise(up)
    return F.when(bare != "", bare)


def _labelled(body: Column, field: str) -> Column:
    """What follows the first such label, to the end of its line; NULL without one."""
    found = F.regexp_extract(body, rf"(?di)\*?\*?{LABELS[field]}\*?\*?:?\s*(.+)", 1)
    return F.when(found != "", found)


def _blocks(text: Column) -> Column:
    """Array of (at, rank, ticker, body): a text cut before each header line. Headers without a number are numbered among themselves."""
    cut = F.split(text, rf"(?md)(?=^[^\n]*\*\*\d+\.[ \t]+(?:{TICKER})(?:[ \t]*[—–-][ \t]*[^\n]+?)?\*\*)|(?=^[ \t\r]*###[ \t]+(?:{TICKER})(?:[ \t]*[—–-][^\n]*|[ \t\r]*)$)")

    def marked(body: Column, at: Column) -> Column:
        head = _trim(F.substring_index(body, "\n", 1))
        number, ticker = F.regexp_extract(head, NUMBERED, 1), F.regexp_extract(head, NUMBERED, 2)
        return F.struct(at.alias("at"), number.alias("number"), ticker.alias("numbered"), F.regexp_extract(head, NAMED, 1).alias("named"), body.alias("body"))

    def entry(x: Column, rank: Column, ticker: str) -> Column:
        return F.struct(x["at"].alias("at"), rank.cast("int").alias("rank"), x[ticker].alias("ticker"), x["body"].alias("body"))

    all_ = F.transform(cut, marked)
    numbered = F.filter(all_, lambda x: x["numbered"] != "")
    named = F.filter(all_, lambda x: (x["numbered"] == "") & (x["named"] != ""))
    return F.concat(F.transform(numbered, lambda x: entry(x, F.coalesce(x["number"].try_cast("int"), F.lit(0)), "numbered")), F.transform(named, lambda x, i: entry(x, i + 1, "named")))


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, also where it stands within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _table(text: Column) -> Column:
    """Lines (at, line) of a text's last table. Blank lines do not end a table, other lines do; it has to reach over three lines."""
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(i.alias("at"), _trim(s).alias("line")))
    is_row = lambda x: F.rlike(x["line"], F.lit(r"^\|(?:.+\|$|[\s:-]+\|)"))
    said = lambda x: ~F.rlike(x["line"], F.lit(r"^\|[\s:-]+\|")) & F.rlike(x["line"], F.lit(r"^\|.+\|$"))
    ats = lambda xs: F.transform(xs, lambda x: x["at"])

    def last(rows: Column) -> Column:
        return F.when(F.get(rows, F.size(rows) - 1)["at"] - F.get(rows, F.lit(0))["at"] >= 2, F.filter(rows, said))

    def cut(s: Column) -> Column:
        before = lambda end: F.coalesce(F.array_max(F.filter(s["others"], lambda at: at < end)), F.lit(-1))
        return _with(_with(F.array_max(ats(s["rows"])), before), lambda at: _with(F.filter(s["rows"], lambda x: x["at"] > at), last))

    split = lambda ls: F.struct(F.filter(ls, is_row).alias("rows"), ats(F.filter(ls, lambda x: ~is_row(x) & (x["line"] != ""))).alias("others"))
    return _with(_with(lines, split), cut)


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.substring(line, F.lit(2), F.length(line) - 2), r"\|"), _trim)


def _header(line: Column) -> Column:
    return F.transform(_cells(line), lambda c: F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("%"), F.lit("pct")))


def _cell(field: str) -> Column:
    """The cell under the first name that the header has; of equal names the last column counts."""
    place = lambda name: F.size("_header") - F.nullif(F.array_position(F.reverse("_header"), F.lit(name)), F.lit(0))
    return F.coalesce(*(F.get("_cells", place(name).cast("int")) for name in COLUMNS[field]))


def _strings(each: DataFrame, *kept: str) -> DataFrame:
    """What a block or a table row says for each field, still as text. Each step's columns are used more than once by the next."""
    block = F.col("from_block")
    told = {f: F.when(block, _labelled(F.col("_body"), f)).otherwise(_cell(f)) for f in COLUMNS if f in LABELS}
    found = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    only = {
        "risk": F.when(block, found(F.col("_body"), RISK)).otherwise(_cell("risk")), "inline": F.when(block, found(F.col("_body"), INLINE_RATIO)),
        "disqualifier_reason": F.when(block, _labelled(F.col("_body"), "disqualifier_reason")), "targets": F.when(block, F.split(_labelled(F.col("_body"), "both_targets"), "/")),
    }
    first = each.select(*kept, *(c.alias(f"_{f}") for f, c in (told | only).items()))
    either = lambda f, k: F.when(F.col("_targets").isNull(), F.col(f)).otherwise(F.get("_targets", F.lit(k)))
    own = lambda f: F.when(block, _said(F.col(f))).otherwise(F.nullif(F.col(f), F.lit("")))
    return first.select(
        *kept, own("_setup").alias("setup"), F.upper(own("_conviction")).alias("conviction"), F.trim("_entry").alias("_entry"), F.trim("_stop").alias("_stop"), either("_target1", 0).alias("_target1"),
        either("_target2", 1).alias("_target2"), F.when(block, F.coalesce(found(F.col("_stop"), RISK), F.col("_risk"))).otherwise(F.col("_risk")).alias("_risk"),
        F.coalesce(found(F.col("_risk_reward"), r"([\d.]+)"), "_inline").alias("_ratio"), _size(F.col("_size")).alias("position_size"), _said(F.col("_hold_period")).alias("hold_period"),
        F.upper(_said(F.col("_accum_distrib"))).alias("accum_distrib"), _said(F.col("_disqualifier_reason")).alias("disqualifier_reason"), F.col("_disqualifier_reason").isNotNull().alias("_refused"))


def _fields() -> list[Column]:
    low, high = fn.entry_zone(F.col("_entry"))
    doomed = F.col("_refused") | (F.col("from_block") & F.coalesce(F.col("conviction").contains("DISQUALIFIED"), F.lit(False)))
    read = {
        "entry_low": low, "entry_high": high, "stop_price": fn.parse_price(F.col("_stop")), "target1": fn.parse_price(F.col("_target1")), "target2": fn.parse_price(F.col("_target2")),
        "risk_pct": fn.parse_percent(F.col("_risk")), "risk_reward": F.col("_ratio").try_cast("double"), "disqualified": doomed,
    }
    return [read.get(f, F.col(f)).alias(f) for f in FIELDS]


def picks(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a pick: id, place (blocks before table rows, each from 0), from_block, rank, ticker and FIELDS.

    A block's fields come before those of the table's row of the same ticker (its last, if it has
    several), which fill what the block lacks; tickers that only the table names keep all its rows.
    A block reaches to the next header, the last one to the text's end, tables included, so that a label
    which it lacks may be found there.
    """
    text = F.col("_text")
    whole = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    cut = whole.select("_id", F.sha2(text, 256).alias("_digest"), _blocks(text).alias("_blocks"), F.coalesce(_table(text), F.array().cast("array<struct<at:int,line:string>>")).alias("_lines"))
    nothing = F.lit(None).cast("string")
    blocks = F.transform("_blocks", lambda x: F.struct(x["at"].alias("at"), F.lit(True).alias("from_block"), x["rank"].alias("rank"), x["ticker"].alias("ticker"), x["body"].alias("body"), nothing.alias("line")))
    rest = F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))
    rows = F.transform(rest, lambda x: F.struct(x["at"].alias("at"), F.lit(False).alias("from_block"), F.lit(None).cast("int").alias("rank"), nothing.alias("ticker"), nothing.alias("body"), x["line"].alias("line")))
    each = cut.select("_id", "_digest", F.get("_lines", F.lit(0))["line"].alias("_head"), F.explode(F.concat(blocks, rows)).alias("_x")).select(
        "_id", "_digest", F.col("_x.at").alias("_at"), F.col("_x.from_block").alias("from_block"), F.col("_x.rank").alias("_rank"), F.col("_x.ticker").alias("_ticker"),
        F.col("_x.body").alias("_body"), _cells(F.col("_x.line")).alias("_cells"), _header(F.col("_head")).alias("_header"))
    named = _trim(F.replace(F.replace(_cell("ticker"), F.lit("**"), F.lit("")), F.lit("#"), F.lit("")))
    number = _cell("rank")
    known = each.withColumns({
        "ticker": F.when(F.col("from_block"), F.col("_ticker")).when(~F.rlike(named, F.lit(r"^\d|^$")), named),
        "rank": F.when(F.col("from_block"), F.col("_rank")).otherwise(F.coalesce(F.when(F.rlike(number, F.lit(r"^[+-]?\d+$")), number).try_cast("int"), F.lit(0))),
    }).where("ticker is not null")
    kept = ["_id", "_digest", "_at", "from_block", "ticker", "rank"]
    read = _strings(known, *kept).select(*kept, *_fields())
    same = Window.partitionBy("_id", "_digest", "ticker")
    table = F.max(F.when(~F.col("from_block"), F.struct("_at", *FILLED))).over(same)
    met = read.withColumn("_table", table).withColumn("_has_block", F.max("from_block").over(same)).where(F.col("from_block") | ~F.col("_has_block"))
    fields = (F.coalesce(F.col(f), F.col("_table")[f]).alias(f) if f in FILLED else F.col(f) for f in FIELDS)
    return met.select(F.col("_id").alias(id_col), F.col("_at").alias("place"), "from_block", "rank", "ticker", *fields)


def outcomes(texts: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row a text: id, parse_success, n_picks and parse_error of its :func:`picks`, for ids that are unique."""
    n = found.groupBy(F.col(id_col).alias("_of")).agg(F.count(F.lit(1)).alias("n_picks"))
    both = texts.select(id_col, text_col).join(n, F.col(id_col).eqNullSafe(F.col("_of")), "left")
    blank = F.coalesce(_trim(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))), F.lit("")) == ""
    error = F.when(blank, "empty response").when(F.col("n_picks").isNull(), "no tickers parsed from response")
    return both.select(id_col, error.isNull().alias("parse_success"), F.coalesce("n_picks", F.lit(0)).alias("n_picks"), error.alias("parse_error"))


HEADER = "MANDATORY OUTPUT CONTRACT"

_SELECTION = (
    "rank int, stock_id string, setup string, accumulation string, rs_composite double, entry_zone_low double, entry_zone_high double, stop double, stop_anchor string, risk_pct double, "
    "target_1 double, target_2 double, rr_ratio double, size string, hold_weeks int, hold_days int, conviction string"
)


def contract_json(text: Column, strings: bool = False) -> Column:
    """The body of the first fence marked json, NULL where that is not closed; without a fence, from the first brace after
    the contract's heading (or of the text) to the one that closes it. With ``strings``, braces inside quoted strings do not count.

    Depth is folded over braces, quotes and the runs between them, not over characters.
    """
    fence = F.locate("```json", text)
    rest = F.substring(text, fence + 7, F.length(text))
    trim = lambda c: F.nullif(F.btrim(c, F.lit(SPACE + "\n")), F.lit(""))
    fenced = F.when(rest.contains("```"), trim(F.substring_index(rest, "```", 1)))
    after = F.substring(text, F.greatest(F.locate(HEADER, text), F.lit(1)), F.length(text))
    bare = F.when(F.instr(after, "{") > 0, F.substring(after, F.instr(after, "{"), F.length(after)))
    tokens = F.regexp_extract_all(bare, F.lit(r'(?s)(\\.|[{}"\\]|[^{}"\\]+)'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        counts = ~s["quoted"]
        depth = s["depth"] + F.when(counts & (c == "{"), 1).when(counts & (c == "}"), -1).otherwise(0)
        at = s["at"] + F.length(c)
        quoted = (c == '"') != s["quoted"] if strings else s["quoted"]
        return F.struct(depth.alias("depth"), quoted.alias("quoted"), at.alias("at"), F.when((s["end"] == 0) & counts & (c == "}") & (depth == 0), at).otherwise(s["end"]).alias("end"))

    end = F.aggregate(tokens, start, step)["end"]
    return F.when(fence > 0, fenced).otherwise(F.when(end > 0, F.substring(bare, F.lit(1), end)))


def contract_selections(texts: DataFrame, known: DataFrame, id_col: str, text_col: str, strings: bool = False) -> DataFrame:
    """A row a selection of a text's JSON contract, and one for each text without any: id, place, the selection's fields, its ticker, error, warning.

    ``known`` gives (id, stock_id, ticker), each stock once a text. A selection is refused whose stock is
    not known, whose stop or lower entry is not positive (missing ones count as zero), or whose stop has no anchor;
    a risk over ten percent is a warning. Texts without a block or with JSON that does not parse have that as their row's error.
    """
    from_text = texts.select(F.col(id_col).alias("_id"), contract_json(F.col(text_col), strings).alias("_json"))
    parsed = from_text.withColumn("_c", F.from_json("_json", _contract_type(), {"columnNameOfCorruptRecord": "_bad"}))
    broken = F.col("_c").isNull() | F.col("_c._bad").isNotNull()
    whole = F.when(F.col("_json").isNull(), "json_block_not_found").when(broken, "json_unmarshal_failed")
    rows = parsed.select("_id", whole.alias("_error"), F.posexplode_outer(F.when(whole.isNull(), F.col("_c.selections"))).alias("place", "_s")).select("_id", "_error", "place", "_s.*")
    ids = known.select(F.col(id_col).alias("_of"), F.col("stock_id").alias("_stock"), "ticker")
    met = rows.join(ids, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("stock_id") == F.col("_stock")), "left").drop("_of", "_stock")
    positive = lambda c: F.coalesce(F.col(c), F.lit(0.0)) > 0
    anchored = F.coalesce(_trim("stop_anchor"), F.lit("")) != ""
    error = (
        F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("place").isNull(), "no_selections").when(F.col("ticker").isNull(), "unknown_stock_id")
        .when(~(positive("stop") & positive("entry_zone_low")), "invalid_stop_or_entry").when(~anchored, "empty_stop_anchor")
    )
    held = F.when(F.coalesce("hold_days", F.lit(0)) > 0, F.concat(F.col("hold_days").cast("string"), F.lit(" days"))).when(F.col("place").isNotNull(), F.concat(F.coalesce("hold_weeks", F.lit(0)).cast("string"), F.lit(" weeks")))
    out = met.withColumn("error", error).withColumn("hold_period", held).withColumn("warning", F.when(F.col("error").isNull() & (F.col("risk_pct") > 10), "risk_pct exceeds 10"))
    return out.withColumnRenamed("_id", id_col).drop("_error", "hold_weeks", "hold_days")


def _contract_type() -> str:
    selection = ",".join(x.strip().replace(" ", ":", 1) for x in _SELECTION.split(","))
    return f"analysis_date string, regime string, selections array<struct<{selection}>>, eliminations array<struct<stock_id:string,step:int,rule:string,value:string>>, _bad string"
