"""Picks of report texts: fields written down beside each text."""

import pytest
from pyspark.sql import Row

from marketloom.operators import parsing

BLOCKS = """
## ANALYSIS

**1. NVDA — Maker of chips**
- **Setup**: TIGHT BASE
- **Conviction**: DISQUALIFIED
- **Disqualifier reason**: too far above its mean
- **Entry zone**: $142.50–$145.00
- **Stop**: $136.80, Risk 4.2%
- **T1 / T2**: $1,155.00 / $1,168.00
- **R/R**: 3.2:1
- **Size**: STANDARD (20%)
- **Hold period**: 1-2 weeks
- **A/D**: Accumulation

**2. STOCK_AB**
Entry range: 198 to 200.50
Target 1: 210
T2: insufficient data
pays **0.54:1**, poor
Risk% (of price): **7.6%**

### AMD — more
Stop: N/A
Conviction: medium **
"""

TABLES = """
| Rank | Ticker |
|---|---|
| 1 | OLD |

then

| # | Symbol | Pattern | Entry | Stop price | Risk% | T1 (3m) | T2 (12m) | R:R | Position | Conviction | Hold | Accum |
|:--|--|--|--|--|--|--|--|--|--|--|--|--|

| 3 | **TSLA** | BREAKOUT | 250.00—255.00 | $240 | 4.0% | 275 | - | 2.5:1 | full (25%) | high | 2 weeks | distrib |
| x | AMD | VCP | 178.50 | 172 | 3.6 | 195 | 210 | 2.8 | starter | low | | |
| 9 | 17 | a number | | | | | | | | | | |
| 5 | SHORT |
"""


@pytest.fixture(scope="module")
def read(spark):
    def of(text):
        rows = parsing.picks(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()
        return {r.ticker: r for r in rows}

    return of


def fields(row):
    return [row[f] for f in parsing.FIELDS]


def test_blocks(read):
    got = read(BLOCKS)
    assert [(r.ticker, r.rank, r.from_block) for r in sorted(got.values(), key=lambda r: r.place)] == [("NVDA", 1, True), ("STOCK_AB", 2, True), ("AMD", 1, True)]
    assert fields(got["NVDA"]) == ["TIGHT BASE", "DISQUALIFIED", 142.5, 145.0, 136.8, 1155.0, 1168.0, 4.2, 3.2, "STANDARD", "1-2 weeks", "ACCUMULATION", True, "too far above its mean"]
    assert fields(got["STOCK_AB"]) == [None, None, 198.0, 200.5, None, 210.0, None, 7.6, 0.54, None, None, None, False, None]
    assert fields(got["AMD"]) == [None, "MEDIUM", None, None, None, None, None, None, None, None, None, None, False, None]


def test_last_table_counts_and_names_vary(read):
    got = read(TABLES)
    assert set(got) == {"TSLA", "AMD", "SHORT"}
    assert got["TSLA"].rank == 3 and got["AMD"].rank == 0
    assert fields(got["TSLA"]) == ["BREAKOUT", "HIGH", 250.0, 255.0, 240.0, 275.0, None, 4.0, 2.5, "FULL", "2 weeks", "DISTRIB", False, None]
    assert fields(got["AMD"])[:10] == ["VCP", "LOW", 178.5, 178.5, 172.0, 195.0, 210.0, 3.6, 2.8, "STARTER"]
    assert fields(got["SHORT"]) == [None] * 12 + [False, None]


def test_blocks_are_filled_from_the_table(read):
    got = read(BLOCKS + TABLES)
    assert set(got) == {"NVDA", "STOCK_AB", "AMD", "TSLA", "SHORT"}
    amd = got["AMD"]
    assert (amd.from_block, amd.rank, amd.setup, amd.conviction, amd.stop_price, amd.hold_period) == (True, 1, "VCP", "MEDIUM", 172.0, None)
    assert not got["TSLA"].from_block


def test_two_lines_are_no_table(read):
    assert read("| Rank | Ticker |\n| 1 | AAPL |") == {}


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "nothing here"), (5, "**1. AAPL**"), (None, "**1. IBM**"), (6, "| a\n" * 20_000), (7, "x" * 500_000 + "\n**4. GE – it**\nStop: 5")]
    df = spark.createDataFrame([(*t, "extra") for t in texts], "id int, text string, ticker string")
    found = parsing.picks(df, "id", "text")
    assert sorted((r.ticker, r.id, r.rank) for r in found.collect()) == [("AAPL", 5, 1), ("GE", 7, 4), ("IBM", None, 1)]
    got = {r.id: (r.parse_success, r.n_picks, r.parse_error) for r in parsing.outcomes(df, found, "id", "text").collect()}
    empty, none = (False, 0, "empty response"), (False, 0, "no tickers parsed from response")
    assert got == {1: empty, 2: empty, 3: empty, 4: none, 5: (True, 1, None), None: (True, 1, None), 6: none, 7: (True, 1, None)}
    assert parsing.picks(df.limit(0), "id", "text").collect() == []


def test_repeated_ids_and_texts(spark):
    df = spark.createDataFrame([(1, "**1. A**\nStop: 5"), (1, "| # | Ticker | Stop |\n|--|--|--|\n| 1 | A | 6 |"), (2, "**1. B**"), (2, "**1. B**")], "id int, text string")
    got = parsing.picks(df, "id", "text").collect()
    assert sorted((r.id, r.ticker, r.stop_price or 0) for r in got) == [(1, "A", 5.0), (1, "A", 6.0), (2, "B", 0), (2, "B", 0)]


GOOD = '{"rank": 1, "stock_id": "STOCK_A", "entry_zone_low": 15.1, "stop": 14.6, "stop_anchor": "low", "risk_pct": %s, "hold_weeks": 3, "hold_days": %s}'


def contract(*selections):
    return '{"analysis_date": "2026-04-26", "selections": [' + ", ".join(selections) + '], "eliminations": []}'


@pytest.mark.parametrize(
    "text, want",
    [
        ("so\n```json\n" + contract(GOOD % (12.5, 0)) + "\n```\n", [("X", None, "risk_pct exceeds 10", "3 weeks")]),
        ("{ no\n## MANDATORY OUTPUT CONTRACT\nhere " + contract(GOOD % (5, 2), GOOD.replace("STOCK_A", "STOCK_Z") % (5, 2)) + " done }", [("X", None, None, "2 days"), (None, "unknown_stock_id", None, "2 days")]),
        (contract((GOOD % (50, 2)).replace("14.6", "0")), [("X", "invalid_stop_or_entry", None, "2 days")]),
        (contract('{"stock_id": "STOCK_A", "stop": 3, "stop_anchor": "low"}'), [("X", "invalid_stop_or_entry", None, "0 weeks")]),
        (contract((GOOD % (5, 2)).replace('"low"', '" "')), [("X", "empty_stop_anchor", None, "2 days")]),
        ("```json\n" + contract(GOOD % (5, 2)), [(None, "json_block_not_found", None, None)]),
        ("no braces", [(None, "json_block_not_found", None, None)]),
        (contract(GOOD % (5, 2))[:-1], [(None, "json_block_not_found", None, None)]),
        ("```json\n{\"selections\": [}\n```", [(None, "json_unmarshal_failed", None, None)]),
        ("```json\n{\"selections\": \"none\"}\n```", [(None, "json_unmarshal_failed", None, None)]),
        (contract(), [(None, "no_selections", None, None)]),
        (None, [(None, "json_block_not_found", None, None)]),
    ],
)
def test_contracts(spark, text, want):
    texts = spark.createDataFrame([(1, text)], "id int, text string")
    known = spark.createDataFrame([(1, "STOCK_A", "X"), (2, "STOCK_Z", "Y")], "id int, stock_id string, ticker string")
    got = parsing.contract_selections(texts, known, "id", "text").orderBy("place").collect()
    assert [(r.ticker, r.error, r.warning, r.hold_period) for r in got] == want


def test_braces_in_strings(spark):
    text = 'x {"a": "}\\"}", "b": {"c": "{"}} y }'
    df = spark.createDataFrame([Row(text=text)])
    plain, quoted = df.select(parsing.contract_json(df.text).alias("p"), parsing.contract_json(df.text, strings=True).alias("q")).first()
    assert plain == '{"a": "}'
    assert quoted == '{"a": "}\\"}", "b": {"c": "{"}}'


def test_a_label_counts_wherever_it_first_stands(read):
    assert read("**1. GM**\nRisk% (to stop): **7.6%**\nStop: 30")["GM"].stop_price == 7.6


def test_the_last_block_reaches_to_the_end(read):
    assert read("**1. GM**\nStop: 30\n\n| Setup | Ticker |\n|--|--|\n| vcp | F |")["GM"].setup == "| Ticker"
