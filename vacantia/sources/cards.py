"""Result cards of web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions.text import flatten_lines

CARD_START = '<div class="results-card-container">'


def _up_to_its_end(rest: Column) -> Column:
    """What stands before the `</div>` that closes an open one; all if none does."""
    pieces = F.split(rest, "</div>", -1)
    opened = F.transform(pieces, lambda piece: F.size(F.split(piece, r"<div\b", -1)) - 1)
    # After piece i, one more than all that were opened must have been closed.
    state = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))
    walked = F.aggregate(
        opened,
        state,
        lambda seen, more: F.when(seen["depth"] == 0, seen).otherwise(
            F.struct((seen["depth"] + more - 1).alias("depth"), (seen["taken"] + 1).alias("taken"))
        ),
    )
    return F.array_join(F.slice(pieces, F.lit(1), walked["taken"]), "</div>")


def page_blocks(pages: DataFrame, block_pattern: str | None = None) -> DataFrame:
    """One row per card block of each page: (page_id, position, card).

    A card is cut at its start and ends where its `div` is closed, with all `div` inside.
    A `block_pattern` finds other blocks, as its first group.
    """
    if block_pattern is None:
        after = F.split("html", F.concat(F.lit("\\Q"), F.lit(CARD_START), F.lit("\\E")), -1)
        blocks = F.transform(F.slice(after, F.lit(2), F.size(after)), _up_to_its_end)
    else:
        blocks = F.regexp_extract_all("html", F.lit(block_pattern), 1)
    return pages.select("page_id", F.posexplode(blocks).alias("position", "card"))


def card_text(card: Column) -> Column:
    """Text of a card without its tags."""
    return F.regexp_replace(card, "<[^>]*>", "")


def page_cards(pages: DataFrame, block_pattern: str | None = None) -> DataFrame:
    cards = page_blocks(pages, block_pattern)
    return cards.select("page_id", "position", card_text(F.col("card")).alias("card"))


def flatten_cards(cards: DataFrame) -> DataFrame:
    return cards.withColumn("card", flatten_lines(F.col("card")))


def distinct_cards(cards: DataFrame) -> DataFrame:
    return cards.select("card").distinct()


def card_report(cards: DataFrame) -> DataFrame:
    return cards.agg(
        F.count("*").alias("cards"), F.count_distinct("card").alias("distinct_cards")
    )


def scrape_coverage(runs: DataFrame) -> DataFrame:
    """Share of the site's printed total (`12,345`) that a run has, in percent.

    NULL when the printed total is absent, not a number, or zero.
    """
    total = F.replace("total_text", F.lit(","), F.lit("")).try_cast("double")
    return runs.withColumn("total", total).withColumn(
        "percent", F.round(F.try_divide(F.col("scraped"), F.col("total")) * 100, 3)
    )
