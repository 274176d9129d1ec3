"""Views that shape the given tables like the engine's inputs."""

from __future__ import annotations

import gzip
from functools import cached_property

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.functions.dates import next_friday, publication_date
from vacantia.functions.text import listing_code
from vacantia.operators.calendar import with_publication_date
from vacantia.operators.dedup import first_per_code, with_code
from vacantia.operators.effects import term_wage_contrast
from vacantia.operators.features import labelled_listings, labelled_samples, wages_and_features
from vacantia.operators.numbering import number_rows
from vacantia.operators.regression import regression_errors
from vacantia.operators.wages import wage_facts
from vacantia.plans.curate import standardised
from vacantia.plans.etl import Phrases, discover_phrases
from vacantia.scratch import fresh_folder, stage
from vacantia.sources.cards import page_blocks
from vacantia.sources.commit_log import qualified
from vacantia.sources.snapshot_format import list_files, write_snapshot_files

CARD_BLOCK = "(?s)<p>(.*?)</p>"
FILE_ORDER = ("source_file", "doc_id")
CUT_BYTES = 200  # of a gzip file, far less than any has

# Fixed value: a raw listing made from a document, with slots for the SQL dialect.
RAW_LISTING = """concat(
  case when doc_id % 23 = 0 then '' else concat(cast(1625000000 +
    (case when doc_id % 10 = 1 then doc_id - 1 else doc_id end) as {S}), ' ') end,
  case when doc_id % 4 = 0 then 'A Convenir '
       when doc_id % 4 = 1 then ''
       else concat('$', cast(1 + doc_id % 5 as {S}), '.000.000',
                   case when doc_id % 11 = 3 then '-' else ' - ' end,
                   '$', cast(2 + doc_id % 5 + doc_id % 3 as {S}), '.000.000 ') end,
  case when doc_id % 5 = 2 then 'Desarrollador Python ' else 'Auxiliar Logística ' end,
  {FLAT}, ' Fecha de Publicación ', {DATE},
  case when doc_id % 97 = 5 then ' ver más' else '' end)"""
DAY_OFFSET = "case when doc_id % 7 = 3 then 5 else doc_id % 60 end"

SPARK_RAW_LISTING = RAW_LISTING.format(
    S="string",
    FLAT=r"translate(text, '\n\r', '  ')",
    DATE=f"date_format(date_add(date'2024-11-15', cast({DAY_OFFSET} as int)), 'dd/MM/yyyy')",
)


class Views:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        """The documents; spread over the cores if they come in fewer parts than cores,
        since one file may be a single unsplittable row group."""
        documents = self.table("documents")
        cores = self.spark.sparkContext.defaultParallelism
        if documents.rdd.getNumPartitions() < cores:
            return documents.repartition(cores, "doc_id")
        return documents

    def raw_documents(self) -> DataFrame:
        """(doc_id, source_file, raw): the listings before they are numbered. `raw` is a
        generated row, so it is made once, and no filter on it moves below the spreading."""
        return self.documents().select(
            "doc_id",
            F.concat(F.lit("vacancies_"), "source", F.lit(".txt.gz")).alias("source_file"),
            F.inline(F.array(F.struct(F.expr(SPARK_RAW_LISTING).alias("raw")))),
        )

    def raw_listings(self) -> DataFrame:
        documents = self.table("documents").select(
            "doc_id",
            F.concat(F.lit("vacancies_"), "source", F.lit(".txt.gz")).alias("source_file"),
            "text",
        )
        return number_rows(documents, "source_file", "doc_id", "line_no").select(
            "source_file", "line_no", F.expr(SPARK_RAW_LISTING).alias("raw")
        )

    def lines(self, **derived: Column) -> DataFrame:
        """Numbered lines with a code and columns derived from `raw`, without the text."""
        columns = [expression.alias(name) for name, expression in derived.items()]
        code = listing_code(F.col("raw")).alias("code")
        facts = self.raw_documents().select("doc_id", "source_file", code, *columns)
        return number_rows(facts, "source_file", "doc_id", "line_no").drop("doc_id")

    def curated(self, **derived: Column) -> DataFrame:
        """One line per code with the derived columns. Documents of a file are numbered in the
        order of their ids, so the first by id is the first by line."""
        columns = [expression.alias(name) for name, expression in derived.items()]
        code = listing_code(F.col("raw")).alias("code")
        facts = self.raw_documents().select("doc_id", "source_file", code, *columns)
        return first_per_code(facts.filter(F.col("code").isNotNull()), FILE_ORDER)

    def dated(self) -> DataFrame:
        return self.curated(pub_date=publication_date(F.col("raw")))

    def wage_facts(self, segment: str | None) -> DataFrame:
        return first_per_code(wage_facts(with_code(self.raw_documents()), segment), FILE_ORDER)

    def first_listings(self) -> DataFrame:
        """(doc_id, code, source_file, line_no, raw), one listing per code. It is chosen by
        position; the text is fetched afterwards by the number of its document."""
        code = listing_code(F.col("raw")).alias("code")
        facts = self.raw_documents().select("doc_id", "source_file", code)
        numbered = number_rows(facts, "source_file", "doc_id", "line_no")
        first = first_per_code(numbered.filter(F.col("code").isNotNull()))
        # Nearly all texts are fetched: they move once, by their number, and the positions are
        # the side that is hashed.
        texts = self.raw_documents().select("doc_id", "raw")
        return texts.join(first.hint("shuffle_hash"), "doc_id")

    def listings(self) -> DataFrame:
        """Standardised listings, one per code; without line numbers the text moves once."""
        first = first_per_code(with_code(self.raw_documents()), FILE_ORDER)
        return standardised(with_publication_date(first))

    @cached_property
    def texts(self) -> DataFrame:
        """Curated listings for steps that scan them repeatedly, written once per query."""
        return stage(self.listings().select("code", "pub_date", "wage_info", "text"), "listings")

    @cached_property
    def phrases(self) -> Phrases:
        return discover_phrases(self.texts)

    def features(self, **options) -> DataFrame:
        return wages_and_features(
            self.texts, self.phrases.unigrams, self.phrases.bigrams, **options
        )

    @cached_property
    def samples(self) -> DataFrame:
        """Labelled samples (code, wage, log_wage, ngrams), written once per query."""
        featured = wages_and_features(
            labelled_listings(self.texts), self.phrases.unigrams, self.phrases.bigrams
        )
        return stage(labelled_samples(featured.select("code", "wage", "ngrams")), "samples")

    def effects(self) -> DataFrame:
        """Model-free effects, rounded so that ranks do not hang on the last bit."""
        return term_wage_contrast(self.samples).select(
            "keyword",
            F.round("marginal_effect", 6).alias("marginal_effect"),
            F.round("prop_doc", 6).alias("prop_doc"),
        )

    def weekly_snapshots(self) -> DataFrame:
        """Curated listings with the Friday snapshot their publication week belongs to."""
        day = publication_date(F.col("raw"))
        return self.curated(snapshot_date=next_friday(day))

    def weekly_lines(self) -> DataFrame:
        """The same, named and numbered like lines of snapshot files."""
        name = F.concat(F.lit("vacancies_"), F.col("snapshot_date").cast("string"), F.lit(".txt.gz"))
        curated = first_per_code(with_code(self.raw_documents()), FILE_ORDER)
        day = next_friday(publication_date(F.col("raw")))
        weekly = (
            curated.withColumn("snapshot_date", day)
            .filter(F.col("snapshot_date").isNotNull())
            .select(name.alias("source_file"), F.col("code").try_cast("bigint").alias("position"), "raw")
        )
        return number_rows(weekly, "source_file", "position", "line_no").select(
            "source_file", "line_no", "raw"
        )

    @cached_property
    def flat_lines(self) -> DataFrame:
        """Lines of the weekly snapshots, of one that is too short, and of one without dates."""
        weekly = stage(self.weekly_lines(), "weekly")
        first = weekly.filter(F.col("source_file") == weekly.agg(F.min("source_file")).scalar())
        short = first.filter("line_no <= 3").withColumn(
            "source_file", F.lit("vacancies_short.txt.gz")
        )
        undated = first.select(
            F.lit("vacancies_undated.txt.gz").alias("source_file"),
            "line_no",
            F.concat("raw", F.lit(" x")).alias("raw"),
        )
        return weekly.unionByName(short).unionByName(undated)

    def flat_folder(self, lines: DataFrame | None = None) -> str:
        """A folder with a gzip file per snapshot, one that was cut off, an empty one, and one
        of another name."""
        folder = fresh_folder(self.spark, "drop")
        write_snapshot_files(self.flat_lines if lines is None else lines, folder)
        store, base = FileSystem.from_uri(qualified(self.spark, folder))
        whole = list_files(qualified(self.spark, folder))
        with store.open_input_stream(whole[0].path, compression=None) as stream:
            cut = stream.read(min(CUT_BYTES, whole[0].length - 1))
        nothing, note = gzip.compress(b"", mtime=0), gzip.compress(b"a note\n", mtime=0)
        for name, content in (
            ("vacancies_damaged.txt.gz", cut), ("vacancies_empty.txt.gz", nothing), ("notes.txt.gz", note)
        ):
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(content)
        return folder

    def processed(self) -> DataFrame:
        """Snapshots with at least an average number of listings."""
        weeks = self.weekly_snapshots().groupBy("snapshot_date").agg(F.count("*").alias("n"))
        average = weeks.agg(F.avg("n")).scalar()
        return weeks.filter(F.col("n") >= average).select("snapshot_date")

    def cards(self) -> DataFrame:
        return page_blocks(self.table("pages"), CARD_BLOCK)

    def scrape_runs(self) -> DataFrame:
        """Per source: scraped documents and a printed total, absent for some."""
        printed = F.format_number(F.count("*") * 125, 0)
        return (
            self.table("documents")
            .groupBy("source")
            .agg(F.count("*").alias("scraped"), printed.alias("printed"))
            .select(
                "source",
                "scraped",
                F.when(~F.col("source").endswith("7"), F.col("printed")).alias("total_text"),
            )
        )

    def predictions(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_returnflag").alias("model"),
            F.col("l_linestatus").alias("split"),
            F.col("l_extendedprice").alias("y"),
            (F.col("l_quantity") * 1000).alias("p"),
        )

    def history(self) -> DataFrame:
        """A history per supplier: its prediction error by shipping month, in order."""
        monthly = regression_errors(
            self.table("lineitem").select(
                F.col("l_suppkey").alias("model"),
                F.date_trunc("month", "l_shipdate").alias("month"),
                F.col("l_extendedprice").alias("y"),
                (F.col("l_quantity") * 1000).alias("p"),
            ),
            "model",
            "month",
        )
        in_order = Window.partitionBy("model").orderBy("month")
        return monthly.select(
            "model",
            F.row_number().over(in_order).alias("epoch"),
            F.round("rmse", 4).alias("val_rmse"),
        )
