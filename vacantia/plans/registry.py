"""Every registered query: a function of a session and a folder of tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import dates as date_functions
from vacantia.functions import ngrams as ngram_functions
from vacantia.functions import text as text_functions
from vacantia.functions import wage as wage_functions
from vacantia.operators import calendar, dedup, effects, features, phrases, regression, splits
from vacantia.operators import training_history, vectors, wages
from vacantia.operators.network import train_wage_network
from vacantia.plans import etl
from vacantia.plans.curate import standardised
from vacantia.plans.fixtures import CARD_BLOCK, Views
from vacantia.scratch import fresh_folder, stage, stage_counting
from vacantia.sources import cards, file_ledger, folds, inference_store, phrase_documents
from vacantia.sources import snapshot_format, snapshots
from vacantia.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

SEGMENT = "python"
CALENDAR = (dt.date(2024, 11, 1), dt.date(2025, 1, 20))
FIRST_SNAPSHOT = dt.date(2024, 11, 15)
TODAY = dt.date(2025, 1, 31)
SCOPE_TARGET = dt.date(2024, 12, 31)
SCOPE_DAYS = 21
WEEKLY_MINIMUM = 100
SAMPLE_SEED = 7
LONG_TEXT = 1000
SAMPLING_RATE = 0.5
INFERENCE_DATES = (dt.datetime(2024, 1, 15), dt.datetime(2025, 12, 15))

_QUERIES: dict[str, Query] = {}


def _dates_as_text(table: DataFrame) -> DataFrame:
    """Dates as ISO text, which every client prints the same."""
    return table.select(
        *[F.col(n).cast("string").alias(n) if t == "date" else n for n, t in table.dtypes]
    )


def query(function: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    _QUERIES[function.__name__] = lambda spark, folder: _dates_as_text(
        function(Views(spark, folder))
    )
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(table: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return table.withColumns({name: F.round(F.col(name), digits) for name in names})


def joined(terms: str | Column) -> Column:
    """An array as one string."""
    text = F.array_join(terms, ",")
    return text.alias(terms) if isinstance(terms, str) else text


# --- snapshots and cards ---


@query
def scan_snapshots(views: Views) -> DataFrame:
    folder = fresh_folder(views.spark, "snapshots")
    snapshots.write_snapshots(views.raw_listings(), folder)
    return snapshots.scan_snapshots(views.spark, folder, partitioned=True)


@query
def write_snapshot(views: Views) -> DataFrame:
    folder = fresh_folder(views.spark, "snapshots")
    snapshots.write_snapshots(views.weekly_lines(), folder)
    return snapshots.scan_snapshots(views.spark, folder, partitioned=True)


def _line_ends(views: Views) -> DataFrame:
    """Numbered lines with only whether they end in a date."""
    return views.lines(dated=snapshots.ends_in_date(F.col("raw")))


@query
def snapshot_gate(views: Views) -> DataFrame:
    return snapshots.snapshot_gate(_line_ends(views))


@query
def snapshot_manifest(views: Views) -> DataFrame:
    def names(table: str, column: str) -> DataFrame:
        name = F.concat(F.lit("vacancies_"), F.col(column), F.lit(".txt.gz"))
        return views.table(table).select(name.alias("source_file")).distinct()

    # Roles stand for files of which no line can be read.
    files = names("documents", "source").unionByName(names("conversations", "role"))
    return snapshots.snapshot_manifest(files, snapshots.snapshot_gate(_line_ends(views)))


@query
def scan_flat_snapshots(views: Views) -> DataFrame:
    return snapshot_format.read_snapshot_files(views.spark, views.flat_folder(), skip_damaged=True)


def _manifest_of_files(views: Views) -> DataFrame:
    """The manifest of real files, from a ledger that a second run has nothing to add to."""
    folder, ledger = views.flat_folder(), fresh_folder(views.spark, "ledger")
    file_ledger.update_ledger(views.spark, folder, ledger)
    if not file_ledger.update_ledger(views.spark, folder, ledger).isEmpty():
        raise RuntimeError("the ledger found unchanged files changed")
    rows = file_ledger.read_ledger(views.spark, ledger)
    return snapshots.snapshot_manifest(
        file_ledger.listed_files(views.spark, folder),
        file_ledger.ledger_gate(rows),
        damaged=rows.filter("damaged"),
    )


@query
def manifest_of_files(views: Views) -> DataFrame:
    return _manifest_of_files(views)


@query
def missing_weeks_of_files(views: Views) -> DataFrame:
    done = file_ledger.processed_dates(_manifest_of_files(views))
    return calendar.missing_weeks(done, FIRST_SNAPSHOT, TODAY)


@query
def valid_lines(views: Views) -> DataFrame:
    return snapshots.valid_lines(
        views.raw_listings(), snapshots.snapshot_gate(_line_ends(views))
    )


@query
def batch_size_gate(views: Views) -> DataFrame:
    return snapshots.batch_size_gate(views.weekly_lines(), WEEKLY_MINIMUM)


@query
def flatten_cards(views: Views) -> DataFrame:
    return cards.flatten_cards(views.cards())


@query
def page_cards(views: Views) -> DataFrame:
    return cards.page_cards(views.table("pages"), CARD_BLOCK)


@query
def nested_cards(views: Views) -> DataFrame:
    """Cards as results pages have them, cut where their own `div` is closed."""
    html = F.array_join(F.transform(
        F.regexp_extract_all("html", F.lit(CARD_BLOCK), 1),
        lambda block: F.concat(
            F.lit(f'<div>before</div>{cards.CARD_START}<div class="title">'), block,
            F.lit("</div><div><div>pay</div> place</div> end</div> between"),
        ),
    ), " ")
    return cards.page_cards(views.table("pages").select("page_id", html.alias("html")))


@query
def distinct_cards(views: Views) -> DataFrame:
    return cards.distinct_cards(views.cards())


@query
def card_report(views: Views) -> DataFrame:
    return cards.card_report(views.cards())


@query
def scrape_coverage(views: Views) -> DataFrame:
    return cards.scrape_coverage(views.scrape_runs())


@query
def preview(views: Views) -> DataFrame:
    return views.raw_listings().orderBy("source_file", "line_no").limit(5)


# --- scalar functions ---


def _over_documents(step: Callable[[Column], Column]) -> Callable[[Views], DataFrame]:
    return lambda views: views.documents().select("doc_id", step(F.col("text")).alias("text"))


for _name, _step in {
    "text_lower": text_functions.lowercase,
    "text_unaccent": text_functions.remove_accents,
    "text_ascii_fold": text_functions.ascii_fold,
    "text_alnum": text_functions.keep_alphanumeric,
    "text_squeeze": text_functions.squeeze_spaces,
}.items():
    _run = _over_documents(_step)
    _run.__name__ = _name
    query(_run)


def _raw(views: Views, *columns: Column) -> DataFrame:
    return views.raw_documents().select("doc_id", *columns)


@query
def standardize_text(views: Views) -> DataFrame:
    return _raw(views, text_functions.standardize(F.col("raw")).alias("text"))


@query
def standardize_some_steps(views: Views) -> DataFrame:
    steps = (text_functions.lowercase, text_functions.squeeze_spaces)
    return _raw(views, text_functions.standardize(F.col("raw"), steps).alias("text"))


@query
def wage_info(views: Views) -> DataFrame:
    return standardised(views.raw_documents()).select(
        "doc_id", "wage_info", "wage_low", "wage_high", "text"
    )


@query
def listing_code(views: Views) -> DataFrame:
    return _raw(views, text_functions.listing_code(F.col("raw")).alias("code"))


@query
def publication_date(views: Views) -> DataFrame:
    return _raw(views, date_functions.publication_date(F.col("raw")).alias("pub_date"))


@query
def wage_category(views: Views) -> DataFrame:
    return _raw(views, wage_functions.wage_category(F.col("raw")).alias("wage_category"))


@query
def wage_midpoint(views: Views) -> DataFrame:
    category = wage_functions.wage_category(F.col("raw"))
    return _raw(views, wage_functions.wage_midpoint(category).alias("midwage"))


@query
def wage_label(views: Views) -> DataFrame:
    label = wage_functions.wage_label(F.col("wage_info")).alias("wage")
    return standardised(views.raw_documents()).select("doc_id", "wage_info", label)


@query
def log_wage(views: Views) -> DataFrame:
    wage = wage_functions.wage_label(F.col("wage_info"))
    logged = standardised(views.raw_documents()).select(
        "doc_id", wage_functions.log_wage(wage).alias("log_wage")
    )
    return rounded(logged, "log_wage")


@query
def tokens(views: Views) -> DataFrame:
    words = ngram_functions.tokens(F.col("text"))
    return standardised(views.raw_documents()).select("doc_id", joined(words).alias("tokens"))


@query
def last_friday(views: Views) -> DataFrame:
    day = date_functions.publication_date(F.col("raw"))
    return _raw(views, day.alias("pub_date"), date_functions.last_friday(day).alias("friday"))


@query
def next_friday(views: Views) -> DataFrame:
    day = date_functions.publication_date(F.col("raw"))
    return _raw(views, day.alias("pub_date"), date_functions.next_friday(day).alias("friday"))


# --- deduplication ---


@query
def dedup_listings(views: Views) -> DataFrame:
    return views.first_listings().select("code", "source_file", "line_no", "raw")


def _codes(views: Views) -> DataFrame:
    return views.raw_documents().select(text_functions.listing_code(F.col("raw")).alias("code"))


@query
def duplicate_codes(views: Views) -> DataFrame:
    return dedup.duplicate_codes(_codes(views))


@query
def top_duplicates(views: Views) -> DataFrame:
    return dedup.top_duplicates(_codes(views), 10)


@query
def duplicate_report(views: Views) -> DataFrame:
    return rounded(dedup.duplicate_report_before_after(_codes(views)), "duplicate_share")


@query
def dedup_with_report(views: Views) -> DataFrame:
    """The report of a deduplication, counted while it was done."""
    kept, report = dedup.dedup_with_report(stage(views.raw_listings(), "lines"))
    records = kept.agg(F.count("*")).scalar()
    return rounded(report.withColumn("kept", records), "duplicate_share")


@query
def segment_filter(views: Views) -> DataFrame:
    in_segment = text_functions.contains_keyword(F.col("text"), SEGMENT)
    return views.listings().filter(in_segment).select("code", "wage_info", "text")


@query
def segment_filter_raw(views: Views) -> DataFrame:
    in_segment = text_functions.contains_keyword(F.col("raw"), SEGMENT)
    return views.raw_documents().filter(in_segment).select("doc_id", "raw")


@query
def segment_pay(views: Views) -> DataFrame:
    return rounded(wages.segment_pay(views.listings(), SEGMENT), "mean_wage", digits=4)


# --- dates ---


@query
def listings_per_date(views: Views) -> DataFrame:
    return calendar.listings_per_date(views.dated())


@query
def calendar_counts(views: Views) -> DataFrame:
    return calendar.calendar_counts(calendar.listings_per_date(views.dated()), *CALENDAR)


@query
def calendar_of_last_days(views: Views) -> DataFrame:
    """The days up to today that a calendar has unless it is told otherwise."""
    return calendar.calendar_counts(calendar.listings_per_date(views.dated()))


@query
def run_last_date(views: Views) -> DataFrame:
    return calendar.run_last_date(
        views.lines(pub_date=date_functions.publication_date(F.col("raw")))
    )


@query
def temporal_scope(views: Views) -> DataFrame:
    scoped = calendar.temporal_scope(views.dated(), SCOPE_TARGET, SCOPE_DAYS)
    return scoped.select("code", "pub_date")


@query
def capped_listings(views: Views) -> DataFrame:
    return calendar.newest_listings(views.dated(), 100).select("code", "pub_date")


@query
def missing_weeks(views: Views) -> DataFrame:
    return calendar.missing_weeks(views.processed(), FIRST_SNAPSHOT, TODAY)


@query
def last_processed(views: Views) -> DataFrame:
    return calendar.last_processed(views.processed(), FIRST_SNAPSHOT)


# --- wages ---


@query
def wage_distribution(views: Views) -> DataFrame:
    shares = wages.wage_distribution(views.wage_facts(SEGMENT))
    return rounded(shares, "proportion_overall", "proportion_segment")


@query
def wage_distribution_overall(views: Views) -> DataFrame:
    """Without a segment."""
    shares = wages.wage_distribution(views.wage_facts(None))
    return rounded(shares, "proportion_overall", "proportion_segment")


@query
def wage_missing_share(views: Views) -> DataFrame:
    return rounded(wages.wage_missing_share(views.wage_facts(SEGMENT)), "share")


@query
def wage_distribution_at_rate(views: Views) -> DataFrame:
    facts = wages.sampled(views.wage_facts(SEGMENT), SAMPLING_RATE, seed=SAMPLE_SEED)
    return rounded(wages.wage_distribution(facts), "proportion_overall", "proportion_segment")


@query
def wage_missing_share_at_rate(views: Views) -> DataFrame:
    facts = wages.sampled(views.wage_facts(SEGMENT), SAMPLING_RATE, seed=SAMPLE_SEED)
    return rounded(wages.wage_missing_share(facts), "share")


# --- phrases ---


@query
def unigram_counts(views: Views) -> DataFrame:
    return phrases.unigram_counts(views.listings())


@query
def bigram_counts(views: Views) -> DataFrame:
    return phrases.bigram_counts(views.listings()).select(phrases.pair_term().alias("term"), "n")


@query
def bigram_lift(views: Views) -> DataFrame:
    return rounded(etl.lifts_of(views.texts), "lift")


@query
def significant_unigrams(views: Views) -> DataFrame:
    return phrases.significant_unigrams(phrases.unigram_counts(views.listings()))


@query
def significant_bigrams(views: Views) -> DataFrame:
    return rounded(phrases.by_lift(views.phrases.bigrams), "lift")


def _exported(views: Views) -> str:
    path = fresh_folder(views.spark, "phrases")
    etl.export_significant_phrases(views.texts, path)
    return path


@query
def phrases_export(views: Views) -> DataFrame:
    path = _exported(views)
    about = phrase_documents.read_about(views.spark, path)
    unigrams, bigrams = phrase_documents.import_ordered(views.spark, path)
    stated = {**about["parameters"], **about["artifact_sizes"]}
    return views.spark.range(1).select(
        *[F.lit(value).alias(name) for name, value in stated.items()],
        unigrams.agg(F.count("*")).scalar().alias("unigrams"),
        bigrams.agg(F.count("*")).scalar().alias("bigrams"),
    )


@query
def phrases_import(views: Views) -> DataFrame:
    unigrams, bigrams = phrase_documents.import_ordered(views.spark, _exported(views))
    return unigrams.withColumn("size", F.lit(1)).unionByName(bigrams.withColumn("size", F.lit(2)))


@query
def phrases_of_filtered_pairs(views: Views) -> DataFrame:
    """Significant pairs as found when the frequent words are too many to broadcast."""
    found = etl.discover_phrases(views.texts, broadcast_bytes=0)
    return rounded(found.bigrams, "lift")


# --- features and samples ---


@query
def doc_unigrams(views: Views) -> DataFrame:
    return views.features().select("code", joined("unigrams"))


@query
def doc_bigrams(views: Views) -> DataFrame:
    return views.features().select("code", joined("bigrams"))


@query
def doc_features(views: Views) -> DataFrame:
    return views.features().select("code", joined("ngrams"))


@query
def doc_features_low_order(views: Views) -> DataFrame:
    return views.features(drop_low_order_ngrams=True).select("code", joined("ngrams"))


@query
def wages_and_features(views: Views) -> DataFrame:
    return views.features().select("code", "wage", joined("ngrams"))


@query
def sample_validity(views: Views) -> DataFrame:
    return rounded(features.sample_validity(views.features()), "valid_share")


@query
def label_counts(views: Views) -> DataFrame:
    return features.label_counts(views.features())


@query
def labelled_samples(views: Views) -> DataFrame:
    # Written, since it is checked before it is used.
    found = stage(views.features().select("code", "wage", "ngrams"), "features")
    samples = features.labelled_samples(features.valid_samples(found))
    return rounded(samples.select("code", "wage", "log_wage", joined("ngrams")), "log_wage")


@query
def vocabulary(views: Views) -> DataFrame:
    return vectors.vocabulary(views.samples)


@query
def vectorize(views: Views) -> DataFrame:
    samples, _ = vectors.vectorize(views.samples)
    return samples.select("code", joined(vectors.present_features()).alias("features"))


@query
def run_sizes(views: Views) -> DataFrame:
    """Sizes of a run, counted while its samples are written."""
    in_segment = F.col("in_segment")
    samples, sizes = stage_counting(
        views.features().select(
            "code", "wage", "ngrams",
            text_functions.contains_keyword(F.col("text"), SEGMENT).alias("in_segment"),
        ),
        "samples",
        documents=F.count("*"),
        segment=F.count_if(in_segment),
        labelled=F.count_if(in_segment & (F.col("wage") > 0)),
    )
    terms = vectors.vocabulary(features.labelled_samples(samples.filter(in_segment)))
    counted = {"vocabulary": terms, "unigrams": views.phrases.unigrams, "bigrams": views.phrases.bigrams}
    return views.spark.range(1).select(
        *[F.lit(sizes[name]).cast("bigint").alias(name) for name in ("documents", "segment", "labelled")],
        *[t.agg(F.count("*")).scalar().alias(name) for name, t in counted.items()],
    )


# --- sampling ---


@query
def sample_listings(views: Views) -> DataFrame:
    lines = views.raw_documents().select("doc_id", "raw")
    return splits.bernoulli_sample(lines, 0.1, "doc_id", SAMPLE_SEED)


@query
def take_sample(views: Views) -> DataFrame:
    return splits.take_sample(views.texts.select("code", "wage_info"), 50, "code", SAMPLE_SEED)


@query
def take_sample_with_replacement(views: Views) -> DataFrame:
    rows = views.texts.select("code", "wage_info")
    return splits.take_sample(rows, 50, "code", SAMPLE_SEED, with_replacement=True)


@query
def train_test_split(views: Views) -> DataFrame:
    split = splits.train_test_split(views.samples, "code", test_share=0.25)
    return split.select("code", "is_train")


def _training_folder(views: Views) -> str:
    folder = fresh_folder(views.spark, "training")
    etl.build_training_samples(
        views.texts, views.phrases.unigrams, views.phrases.bigrams, SEGMENT, folder
    )
    return folder


@query
def persist_folds(views: Views) -> DataFrame:
    return folds.read_folds(views.spark, _training_folder(views)).select("code", "fold")


@query
def read_folds(views: Views) -> DataFrame:
    samples = folds.read_folds(views.spark, _training_folder(views))
    present = joined(vectors.present_features()).alias("features")
    return rounded(samples.select("code", "wage", "label", present), "label")


@query
def split_folds_raw_wage(views: Views) -> DataFrame:
    split = etl.split_folds(views.spark, _training_folder(views), 0.25, 42, use_log_wage=False)
    return split.select("code", "label", "is_train")


@query
def run_metadata(views: Views) -> DataFrame:
    folder = _training_folder(views)
    metadata = folds.read_run_metadata(views.spark, folder)
    sizes = (len(metadata.feature_names), metadata.full_sample_size, metadata.segment_keyword)
    names = ",".join(metadata.feature_names)
    return views.spark.createDataFrame(
        [(*sizes, names)],
        "vocabulary_size bigint, full_sample_size bigint, segment_keyword string, names string",
    )


# --- effects ---


@query
def term_prop_doc(views: Views) -> DataFrame:
    return rounded(effects.term_prop_doc(views.samples), "prop_doc")


@query
def term_wage_contrast(views: Views) -> DataFrame:
    return views.effects()


@query
def effects_discovery(views: Views) -> DataFrame:
    return rounded(effects.effects_discovery(views.effects()), "prop_doc", digits=4)


@query
def effects_rank(views: Views) -> DataFrame:
    return rounded(effects.effects_rank(views.effects()), "prop_doc", digits=4)


@query
def effects_top_abs(views: Views) -> DataFrame:
    return effects.effects_top_abs(views.effects())


# --- models ---


@query
def regression_errors(views: Views) -> DataFrame:
    errors = regression.regression_errors(views.predictions(), "model", "split")
    return rounded(errors, "rmse", "mae", digits=4)


@query
def early_stop_epoch(views: Views) -> DataFrame:
    return training_history.early_stop_epoch(
        views.history(), threshold=0.005, min_epochs=30, window=15
    )


@query
def best_epoch(views: Views) -> DataFrame:
    return training_history.best_epoch(views.history())


def _labelled_vectors(views: Views) -> tuple[DataFrame, list[str]]:
    samples, names = vectors.vectorize(views.samples)
    return samples.withColumn("label", F.col("log_wage")), names


@query
def wage_regression(views: Views) -> DataFrame:
    samples, _ = _labelled_vectors(views)
    split = splits.train_test_split(samples, "code", test_share=0.25)
    model = regression.fit_wage_regression(split.filter("is_train"))
    return model.transform(split).select("code", "is_train", "label", "prediction")


@query
def wage_by_phrase_count(views: Views) -> DataFrame:
    """Log wage on the number of phrases: a regression that SQL has too."""
    phrases_of = F.array(F.size("ngrams").cast("double"))
    samples = views.samples.select(
        "code", F.col("log_wage").alias("label"), array_to_vector(phrases_of).alias("features")
    )
    model = regression.fit_wage_regression(samples, reg_param=0.0, tolerance=1e-12)
    return rounded(
        model.transform(samples).select("code", "label", "prediction"), "label", "prediction", digits=4
    )


@query
def wage_mlp(views: Views) -> DataFrame:
    samples, names = _labelled_vectors(views)
    split = splits.train_test_split(samples, "code", test_share=0.25)
    trained = train_wage_network(split, len(names), epochs=150, threshold=0.005, window=15)
    return views.spark.createDataFrame(
        trained.history, "epoch int, train_rmse double, val_rmse double"
    )


@query
def marginal_effects(views: Views) -> DataFrame:
    samples, names = _labelled_vectors(views)
    model = regression.fit_wage_regression(samples)
    return regression.marginal_effects(samples, names, model.coefficients.toArray())


@query
def discover_wage_drivers(views: Views) -> DataFrame:
    store = fresh_folder(views.spark, "inferences")
    etl.discover_wage_drivers(views.spark, _training_folder(views), store, *INFERENCE_DATES)
    return inference_store.effects_by_inference(
        inference_store.read_inferences(views.spark, store),
        inference_store.read_effects(views.spark, store),
    ).select("inference_id", "segment_keyword", "sample_size", "keyword", "marginal_effect", "prop_doc")


@query
def wage_drivers_of_two_features(views: Views) -> DataFrame:
    """From folds to stored effects, with two features and no penalty, which SQL has too."""
    text = F.col("text")
    present = F.array(
        F.when(text_functions.contains_keyword(text, SEGMENT), F.lit(SEGMENT)),
        F.when(F.length(text) > LONG_TEXT, F.lit("long")),
    )
    samples = views.texts.select(
        "code", wage_functions.wage_label(F.col("wage_info")).alias("wage"),
        F.array_compact(present).alias("ngrams"),
    )
    vectorised, names = vectors.vectorize(features.labelled_samples(samples), min_df=1)
    folder, store = (fresh_folder(views.spark, name) for name in ("training", "inferences"))
    folds.persist_folds(
        vectorised.select("code", "wage", "log_wage", "features"),
        folder,
        {"feature_names": names, "full_sample_size": samples.count(), "segment_keyword": "all"},
    )
    etl.discover_wage_drivers(
        views.spark, folder, store, *INFERENCE_DATES, reg_param=0.0, tolerance=1e-12
    )
    found = inference_store.effects_by_inference(
        inference_store.read_inferences(views.spark, store),
        inference_store.read_effects(views.spark, store),
    ).select(
        "inference_id", "segment_keyword", "sample_size", "vocabulary_size",
        "keyword", "marginal_effect", "prop_doc",
    )
    return rounded(rounded(found, "marginal_effect", digits=4), "prop_doc")


# --- inference store ---


def _commit(views: Views, store: str, segment: str, effects_table: DataFrame) -> int:
    return inference_store.commit_inference(
        views.spark,
        store,
        segment,
        *INFERENCE_DATES,
        sample_size=views.samples.count(),
        vocabulary_size=effects_table.count(),
        effects=effects_table,
    )


def _store_with_two(views: Views) -> str:
    """Two inferences and the effects of a commit that never finished."""
    store = fresh_folder(views.spark, "inferences")
    table = stage(effects.in_discovery_range(views.effects()), "effects")
    _commit(views, store, SEGMENT, table)
    _commit(views, store, "logistica", table.filter(F.col("marginal_effect") > 0))
    table.select(F.xxhash64("keyword").alias("id"), "*").write.parquet(
        f"{store}/marginal_effects/inference_id=3"
    )
    return store


def _stored_effects(views: Views, store: str, **selection) -> DataFrame:
    return inference_store.effects_by_inference(
        inference_store.read_inferences(views.spark, store),
        inference_store.read_effects(views.spark, store),
        **selection,
    ).select(
        "inference_id", "segment_keyword", "sample_size", "vocabulary_size",
        "keyword", "marginal_effect", "prop_doc",
    )


@query
def commit_inference(views: Views) -> DataFrame:
    return _stored_effects(views, _store_with_two(views))


@query
def effects_by_inference(views: Views) -> DataFrame:
    return _stored_effects(views, _store_with_two(views), segment="logistica")


@query
def effects_by_keyword(views: Views) -> DataFrame:
    """The effects of the first keyword in the discovery range, in every inference."""
    first = effects.in_discovery_range(views.effects()).agg(F.min("keyword")).first()[0]
    return _stored_effects(views, _store_with_two(views), keyword=first)


@query
def cascade_delete(views: Views) -> DataFrame:
    store = _store_with_two(views)
    inference_store.delete_inference(views.spark, store, 1)
    return _stored_effects(views, store)


# --- streaming ---


def _two_arrivals(views: Views, run: Callable[[str, str, str], object]) -> str:
    """Let the files arrive in two lots, later names first, with a stream run after each."""
    source, target, checkpoint = (
        fresh_folder(views.spark, name) for name in ("drop", "stream", "stream-checkpoint")
    )
    lines = views.raw_listings()
    late = F.col("source_file") < "vacancies_src15"
    for mode, lot in (("overwrite", ~late), ("append", late)):
        snapshots.write_snapshots(lines.filter(lot), source, mode)
        run(source, target, checkpoint).awaitTermination()
    return target


@query
def stream_ingest(views: Views) -> DataFrame:
    target = _two_arrivals(
        views, lambda *paths: ingest.stream_ingest(views.spark, *paths, partitioned=True)
    )
    return ingest.read_ingested(views.spark, target).select(
        "source_file", "line_no", "wage_info", "text"
    )


@query
def stream_flat_ingest(views: Views) -> DataFrame:
    """Snapshot files that arrive in two lots, among them one that was cut off."""
    late = F.col("source_file") < "vacancies_2024-12"
    source = views.flat_folder(views.flat_lines.filter(~late))
    target, checkpoint = (fresh_folder(views.spark, n) for n in ("stream", "stream-checkpoint"))
    ingest.stream_ingest_files(views.spark, source, target, checkpoint).awaitTermination()
    snapshot_format.write_snapshot_files(views.flat_lines.filter(late), source)
    ingest.stream_ingest_files(views.spark, source, target, checkpoint).awaitTermination()
    return ingest.read_ingested(views.spark, target).select(
        "source_file", "line_no", "wage_info", "text"
    )


@query
def stream_dedup(views: Views) -> DataFrame:
    target = _two_arrivals(
        views, lambda *paths: ingest.stream_dedup(views.spark, *paths, partitioned=True)
    )
    return ingest.curated(views.spark, target).select("code", "source_file", "line_no", "pub_date")
