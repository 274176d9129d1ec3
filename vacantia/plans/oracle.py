"""The registered queries once more as SQL over the same tables.

Each entry states its result from the tables alone; named steps that several entries
share are common table expressions, and an entry gets those it refers to.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from vacantia import constants as C
from vacantia.functions.text import ASCII_SPACE, UNICODE_SPACE
from vacantia.plans.fixtures import CARD_BLOCK, DAY_OFFSET, RAW_LISTING

RAW = RAW_LISTING.format(
    S="varchar",
    FLAT=r"regexp_replace(text, '[\n\r]', ' ', 'g')",
    DATE=f"strftime(date '2024-11-15' + cast({DAY_OFFSET} as integer), '%d/%m/%Y')",
)
NUMBER = r"(\d+)\s+(\d+)\s+(\d+)"


def standard(text: str) -> str:
    ascii_text = f"regexp_replace(strip_accents(lower({text})), '[^\\x00-\\x7f]', '', 'g')"
    kept = f"regexp_replace({ascii_text}, '[^a-zA-Z0-9{ASCII_SPACE}]', '', 'g')"
    return f"trim(regexp_replace({kept}, '[{ASCII_SPACE}]+', ' ', 'g'))"


def plain_number(group: int) -> str:
    return f"regexp_replace(regexp_extract(std, '^{NUMBER}', {group}), '^0+(\\d)', '\\1')"


def hash_of(key: str, seed: int) -> str:
    return f"cast('0x' || substr(md5('{seed}:' || {key}), 1, 15) as bigint)"


def standardised(lines: str) -> str:
    """wage_info, bounds and remaining text of a relation with a `raw` column."""
    return f"""select * exclude (std),
        try_cast(regexp_extract(wage_info, '{C.WAGE_LABEL_PATTERN}', 1) as bigint) as wage_low,
        try_cast(regexp_extract(wage_info, '{C.WAGE_LABEL_PATTERN}', 2) as bigint) as wage_high
      from (
        select *,
          case when regexp_matches(std, '^{NUMBER}')
               then {plain_number(2)} || '-' || {plain_number(3)}
               when contains(std, 'a convenir') then 'a convenir' end as wage_info,
          case when regexp_matches(std, '^{NUMBER}')
               then trim(regexp_replace(std, '^{NUMBER}', ''))
               when contains(std, 'a convenir')
               then trim(regexp_replace(std, '\\s*a convenir', '', 'g'))
               else std end as text
        from (select *, {standard('raw')} as std from {lines}) s) t"""


def wage_category(raw: str) -> str:
    found = f"regexp_extract({raw}, '{C.WAGE_CATEGORY_PATTERN}')"
    return (
        f"case when {found} in ('', 'A Convenir') then 'Not Specified' else {found} end"
    )


def midwage(category: str) -> str:
    def amount(group: int) -> str:
        found = f"regexp_extract({category}, '{C.WAGE_MIDPOINT_PATTERN}', {group})"
        return f"try_cast(replace(replace({found}, '.', ''), ',', '') as bigint)"

    return f"({amount(1)} + {amount(2)}) / 2.0"


def date_of(raw: str) -> str:
    found = f"regexp_extract({raw}, '{C.PUBLICATION_PATTERN}', 1)"
    return f"cast(try_strptime({found}, '%d/%m/%Y') as date)"


CODE = "nullif(regexp_extract(raw, '^\\d+'), '')"
NEXT_FRIDAY = "cast({d} + cast((12 - isodow({d})) % 7 as integer) as date)"
LAST_FRIDAY = "cast({d} - cast((isodow({d}) + 2) % 7 as integer) as date)"


def vocabulary_of(samples: str) -> str:
    return f"""select term, cast(count(distinct code) as bigint) as n_docs, count(*) as n_total
      from (select code, unnest(string_split(ngrams, ',')) as term from {samples}
            where ngrams <> '') e
      group by term having count(distinct code) >= {C.MIN_DOCUMENT_FREQUENCY}"""


def vectors_of(samples: str, vocabulary: str) -> str:
    return f"""select s.code, coalesce(string_agg(cast(i.idx as varchar), ',' order by i.idx), '')
        as features
      from {samples} s left join (
        select distinct e.code, v.idx
        from (select code, unnest(string_split(ngrams, ',')) as term from {samples}) e
        join (select term, row_number() over (order by n_total desc, term) - 1 as idx
              from {vocabulary}) v using (term)) i using (code)
      group by s.code"""


STEPS: dict[str, str] = {
    "raw_documents": f"""select doc_id, concat('vacancies_', source, '.txt.gz') as source_file,
      {RAW} as raw from documents""",
    "raw_listings": """select source_file,
      row_number() over (partition by source_file order by doc_id) as line_no, raw
      from raw_documents""",
    "coded": f"select *, {CODE} as code from raw_listings",
    "deduplicated": """select * from coded where code is not null
      qualify row_number() over (partition by code order by source_file, line_no) = 1""",
    "listings": standardised(f"(select *, {date_of('raw')} as pub_date from deduplicated)"),
    "standard_documents": standardised("raw_documents"),
    "gate": rf"""select source_file, count(*) as lines_checked,
      count(*) filter (regexp_matches(raw, '\d{{2}}/\d{{2}}/\d{{4}}[{UNICODE_SPACE}]*$'))
        as lines_dated
      from raw_listings where line_no <= 10 group by source_file""",
    "valid": """select l.* from raw_listings l join gate g using (source_file)
      where g.lines_checked = 10 and g.lines_dated = 10""",
    "weekly": f"""select *, {NEXT_FRIDAY.format(d='pub_date')} as snapshot_date from listings""",
    "weekly_lines": """select source_file,
      row_number() over (partition by source_file order by position) as line_no, raw
      from (select 'vacancies_' || cast(snapshot_date as varchar) || '.txt.gz' as source_file,
                   cast(code as bigint) as position, raw from weekly) w""",
    "flat_lines": """select * from weekly_lines
      union all select 'vacancies_short.txt.gz', line_no, raw from weekly_lines
        where line_no <= 3 and source_file = (select min(source_file) from weekly_lines)
      union all select 'vacancies_undated.txt.gz', line_no, raw || ' x' from weekly_lines
        where source_file = (select min(source_file) from weekly_lines)""",
    "flat_gate": rf"""select source_file, count(*) as lines_checked,
      count(*) filter (regexp_matches(raw, '\d{{2}}/\d{{2}}/\d{{4}}[{UNICODE_SPACE}]*$'))
        as lines_dated
      from flat_lines where line_no <= 10 group by source_file""",
    "flat_valid": """select l.* from flat_lines l join flat_gate g using (source_file)
      where g.lines_checked = 10 and g.lines_dated = 10""",
    "processed": """select snapshot_date from (
      select snapshot_date, count(*) as n, avg(count(*)) over () as mean
      from weekly group by snapshot_date) w where n >= mean""",
    "cards": f"""select page_id, cast(unnest(range(len(blocks))) as integer) as position,
      unnest(blocks) as card
      from (select page_id, regexp_extract_all(html, '{CARD_BLOCK}', 1) as blocks from pages) b""",
    "words": """select code, unnest(range(len(parts))) as pos, unnest(parts) as term
      from (select code, string_split(text, ' ') as parts from listings where text <> '') p""",
    "unigrams": "select term, count(*) as n from words group by term",
    "pairs": """select code, term as first, lead(term) over (partition by code order by pos)
      as second from words""",
    "bigrams": """select first, second, count(*) as n from pairs where second is not null
      group by first, second""",
    "documents_counted": "select count(*) as total from listings",
    "lifts": f"""select b.first || ' ' || b.second as term, b.n,
      case when coalesce(u1.n, 0) < {C.MIN_UNIGRAM_COUNT}
             or coalesce(u2.n, 0) < {C.MIN_UNIGRAM_COUNT} then -1.0
           else b.n / (cast(u1.n as double) * u2.n
             / (select total from documents_counted)) end as lift
      from bigrams b left join unigrams u1 on u1.term = b.first
      left join unigrams u2 on u2.term = b.second""",
    "known_unigrams": f"""select * from unigrams where n >= {C.MIN_UNIGRAM_COUNT}
      and regexp_matches(term, '{C.PHRASE_PATTERN}')""",
    "known_bigrams": f"""select * from lifts where lift > {C.LIFT_THRESHOLD}
      and regexp_matches(term, '{C.PHRASE_PATTERN}')""",
    "kept_words": f"""select w.code, w.term,
      row_number() over (partition by w.code order by w.pos) as pos,
      lead(w.term) over (partition by w.code order by w.pos) as following
      from words w semi join known_unigrams u on u.term = w.term
      where regexp_matches(w.term, '{C.TOKEN_PATTERN}')""",
    "kept_pairs": """select k.code, k.pos, k.term || ' ' || k.following as term
      from kept_words k semi join known_bigrams b on b.term = k.term || ' ' || k.following""",
    "features": """select l.code, l.text,
      (cast(l.wage_low as double) + l.wage_high) / 2 as wage,
      coalesce(u.terms, '') as unigrams, coalesce(b.terms, '') as bigrams,
      concat_ws(',', u.terms, b.terms) as ngrams, concat_ws(',', s.terms, b.terms) as low_order
      from listings l
      left join (select code, string_agg(term, ',' order by pos) as terms
                 from kept_words group by code) u using (code)
      left join (select code, string_agg(term, ',' order by pos) as terms
                 from kept_pairs group by code) b using (code)
      left join (select k.code, string_agg(k.term, ',' order by k.pos) as terms
                 from kept_words k anti join kept_pairs p on p.code = k.code and p.pos = k.pos
                 where k.following is not null group by k.code) s using (code)""",
    "samples": """select code, wage, ln(wage) as log_wage, ngrams, text from features
      where wage > 0""",
    "segment_samples": "select * from samples where contains(text, 'python')",
    "vocabulary": vocabulary_of("samples"),
    "segment_vocabulary": vocabulary_of("segment_samples"),
    "sample_terms": """select distinct code, log_wage, unnest(string_split(ngrams, ',')) as keyword
      from samples where ngrams <> ''""",
    "effects": """select keyword,
      round(sum(t.log_wage) / count(*) - (any_value(a.s) - sum(t.log_wage))
        / nullif(any_value(a.n) - count(*), 0), 6) as marginal_effect,
      round(count(*) / any_value(a.n), 6) as prop_doc
      from sample_terms t, (select count(*) as n, sum(log_wage) as s from samples) a
      group by keyword""",
    "discovery": "select * from effects where prop_doc between 0.05 and 0.25",
    "inference_rows": """select cast(1 as bigint) as inference_id, 'python' as segment_keyword, * from discovery
      union all select 2, 'logistica', * from discovery where marginal_effect > 0""",
    "stored": """select inference_id, segment_keyword,
      (select count(*) from samples) as sample_size,
      count(*) over (partition by inference_id) as vocabulary_size,
      keyword, marginal_effect, prop_doc from inference_rows""",
    "two_features": f"""select *, row_number() over (order by {hash_of('code', 42)}, code)
        <= floor(count(*) over () * 0.5) as is_train
      from (select code, ln((cast(wage_low as double) + wage_high) / 2) as y,
              cast(contains(text, 'python') as double) as a,
              cast(length(text) > 1000 as double) as b
            from listings where cast(wage_low as double) + wage_high > 0) s""",
    "two_slopes": """select
      (bb * ay - ab * bz) / (aa * bb - ab * ab) as slope_a,
      (aa * bz - ab * ay) / (aa * bb - ab * ab) as slope_b
      from (select covar_pop(a, a) as aa, covar_pop(b, b) as bb, covar_pop(a, b) as ab,
              covar_pop(a, y) as ay, covar_pop(b, y) as bz from two_features where is_train) c""",
    "history": """select model, cast(row_number() over (partition by model order by month) as integer)
      as epoch, val_rmse from (
      select l_suppkey as model, date_trunc('month', l_shipdate) as month,
        round(sqrt(avg((l_extendedprice - l_quantity * 1000)
                     * (l_extendedprice - l_quantity * 1000))), 4) as val_rmse
      from lineitem group by 1, 2) m""",
    "sampled_rows": f"""select code, wage_info, {hash_of('code', 7)} as h,
      row_number() over (order by {hash_of('code', 7)}, code) as place from listings""",
}


def over_documents(expression: str) -> str:
    return f"select doc_id, {expression} as text from documents"


def of_raw(expression: str, name: str) -> str:
    return f"select doc_id, {expression} as {name} from raw_documents"


PUB = date_of("raw")
IN_SEGMENT = "contains(lower(raw), 'python')"
HALF_OF_LISTINGS = (
    f"(select * from listings where {hash_of('code', 7)} < {int(0.5 * (1 << 60))}) half"
)


def wage_distribution(lines: str) -> str:
    return f"""select coalesce(o.wage_category, s.wage_category) as wage_category,
      round(o.n / o.total, 6) as proportion_overall, {midwage('o.wage_category')} as midwage_overall,
      round(s.n / s.total, 6) as proportion_segment, {midwage('s.wage_category')} as midwage_segment
      from (select {wage_category('raw')} as wage_category, count(*) as n,
              sum(count(*)) over () as total from {lines} group by 1) o
      full join (select {wage_category('raw')} as wage_category, count(*) as n,
              sum(count(*)) over () as total from {lines} where {IN_SEGMENT} group by 1) s
        on o.wage_category = s.wage_category"""


def wage_missing_share(lines: str) -> str:
    return f"""select scope, wage_status,
      round(avg(case when missing = (wage_status = 'Not Specified') then 1.0 else 0.0 end), 6) as share
      from (select 'overall' as scope, {wage_category('raw')} = 'Not Specified' as missing
            from {lines}
            union all select 'segment', {wage_category('raw')} = 'Not Specified'
            from {lines} where {IN_SEGMENT}) l,
        (values ('Wage Provided'), ('Not Specified')) v(wage_status)
      group by scope, wage_status"""


ENTRIES: dict[str, str] = {
    "scan_snapshots": "select * from raw_listings",
    "write_snapshot": "select * from weekly_lines",
    "snapshot_gate": """select *, lines_checked = 10 and lines_dated = 10 as valid from gate""",
    "snapshot_manifest": """select source_file,
      case when lines_checked = 10 and lines_dated = 10 then 'valid' else 'discarded' end as status,
      case when lines_checked is null then 'no readable line'
           when lines_checked < 10 then 'too few lines'
           when lines_dated < 10 then 'line without date' end as reason
      from (select distinct 'vacancies_' || source || '.txt.gz' as source_file from documents
            union all
            select distinct 'vacancies_' || role || '.txt.gz' from conversations) f
      left join gate using (source_file)""",
    "scan_flat_snapshots": "select * from flat_lines",
    "manifest_of_files": """select source_file,
      case when lines_checked = 10 and lines_dated = 10 then 'valid' else 'discarded' end as status,
      case when source_file = 'vacancies_damaged.txt.gz' then 'damaged'
           when lines_checked is null then 'no readable line'
           when lines_checked < 10 then 'too few lines'
           when lines_dated < 10 then 'line without date' end as reason
      from (select source_file from flat_gate union all select 'vacancies_damaged.txt.gz'
            union all select 'vacancies_empty.txt.gz') f
      left join flat_gate using (source_file)""",
    "missing_weeks_of_files": """select snapshot_date from (
      select cast(unnest(generate_series(date '2024-11-15', date '2025-01-31', interval 7 day))
        as date) as snapshot_date) f
      where 'vacancies_' || cast(snapshot_date as varchar) || '.txt.gz' not in (
        select source_file from flat_valid)""",
    "valid_lines": "select * from valid",
    "batch_size_gate": """select * from weekly_lines
      qualify count(*) over (partition by source_file) >= 100""",
    "flatten_cards": """select page_id, position, replace(replace(card, chr(10), ' '), chr(13), ' ')
      as card from cards""",
    "page_cards": """select page_id, position, regexp_replace(card, '<[^>]*>', '', 'g') as card
      from cards""",
    "nested_cards": """select page_id, position,
      regexp_replace(card, '<[^>]*>', '', 'g') || 'pay place end' as card from cards""",
    "distinct_cards": "select distinct card from cards",
    "card_report": "select count(*) as cards, count(distinct card) as distinct_cards from cards",
    "scrape_coverage": """select *, round(scraped / total * 100, 3) as percent
      from (select *, try_cast(replace(total_text, ',', '') as double) as total
            from (select source, count(*) as scraped,
                    case when not source like '%7' then format('{:,}', count(*) * 125) end
                      as total_text
                  from documents group by source) r) t""",
    "preview": "select * from raw_listings order by source_file, line_no limit 5",
    "text_lower": over_documents("lower(text)"),
    "text_unaccent": over_documents("strip_accents(text)"),
    "text_ascii_fold": over_documents(
        r"regexp_replace(strip_accents(text), '[^\x00-\x7f]', '', 'g')"
    ),
    "text_alnum": over_documents(f"regexp_replace(text, '[^a-zA-Z0-9{UNICODE_SPACE}]', '', 'g')"),
    "text_squeeze": over_documents(f"trim(regexp_replace(text, '[{UNICODE_SPACE}]+', ' ', 'g'))"),
    "standardize_text": of_raw(standard("raw"), "text"),
    "standardize_some_steps": of_raw(
        f"trim(regexp_replace(lower(raw), '[{UNICODE_SPACE}]+', ' ', 'g'))", "text"
    ),
    "wage_info": "select doc_id, wage_info, wage_low, wage_high, text from standard_documents",
    "listing_code": of_raw(CODE, "code"),
    "publication_date": of_raw(PUB, "pub_date"),
    "wage_category": of_raw(wage_category("raw"), "wage_category"),
    "wage_midpoint": of_raw(midwage(wage_category("raw")), "midwage"),
    "wage_label": """select doc_id, wage_info, (cast(wage_low as double) + wage_high) / 2 as wage
      from standard_documents""",
    "log_wage": """select doc_id, round(ln((cast(wage_low as double) + wage_high) / 2), 6) as log_wage
      from standard_documents""",
    "tokens": f"""select doc_id, array_to_string(list_filter(string_split(text, ' '),
      lambda t: regexp_matches(t, '{C.TOKEN_PATTERN}')), ',') as tokens from standard_documents""",
    "last_friday": f"""select doc_id, pub_date, {LAST_FRIDAY.format(d='pub_date')} as friday
      from (select doc_id, {PUB} as pub_date from raw_documents) d""",
    "next_friday": f"""select doc_id, pub_date, {NEXT_FRIDAY.format(d='pub_date')} as friday
      from (select doc_id, {PUB} as pub_date from raw_documents) d""",
    "dedup_listings": "select code, source_file, line_no, raw from deduplicated",
    "duplicate_codes": """select code, count(*) as n from coded where code is not null
      group by code having count(*) > 1""",
    "top_duplicates": """select code, count(*) as n from coded where code is not null
      group by code having count(*) > 1 order by n desc, code limit 10""",
    "duplicate_report": """select stage, cast(sum(n) as bigint) as records,
      cast(coalesce(sum(n) filter (code is not null and n > 1), 0) as bigint) as duplicates,
      round(coalesce(sum(n) filter (code is not null and n > 1), 0) / sum(n), 6) as duplicate_share
      from (select 'before' as stage, code, count(*) as n from coded group by code
            union all select 'after', code, count(*) from deduplicated group by code) s
      group by stage""",
    "dedup_with_report": """select stage, cast(sum(n) as bigint) as records,
      cast(coalesce(sum(n) filter (code is not null and n > 1), 0) as bigint) as duplicates,
      round(coalesce(sum(n) filter (code is not null and n > 1), 0) / sum(n), 6) as duplicate_share,
      (select count(*) from deduplicated) as kept
      from (select 'before' as stage, code, count(*) as n from coded group by code
            union all select 'after', code, count(*) from deduplicated group by code) s
      group by stage""",
    "segment_filter": """select code, wage_info, text from listings
      where contains(text, 'python')""",
    "segment_filter_raw": f"select doc_id, raw from raw_documents where {IN_SEGMENT}",
    "segment_pay": """select count(wage) as listings, round(avg(wage), 4) as mean_wage
      from (select (cast(wage_low as double) + wage_high) / 2 as wage from listings
            where contains(text, 'python')) s""",
    "listings_per_date": """select pub_date as date, count(*) as count from listings
      where pub_date is not null group by pub_date""",
    "calendar_counts": """select d.date, coalesce(c.n, 0) as count, isodow(d.date) = 1 as marked
      from (select cast(unnest(generate_series(date '2024-11-01', date '2025-01-20',
              interval 1 day)) as date) as date) d
      left join (select pub_date as date, count(*) as n from listings group by 1) c using (date)""",
    "calendar_of_last_days": """select d.date, coalesce(c.n, 0) as count, isodow(d.date) = 1 as marked
      from (select cast(unnest(generate_series(current_date - 60, current_date, interval 1 day))
        as date) as date) d
      left join (select pub_date as date, count(*) as n from listings group by 1) c using (date)""",
    "run_last_date": f"""select source_file, {PUB} as last_date from raw_listings
      qualify row_number() over (partition by source_file order by line_no desc) = 1""",
    "temporal_scope": """select code, pub_date from listings
      where date_diff('day', pub_date, date '2024-12-31') between 0 and 21""",
    "capped_listings": """select code, pub_date from listings
      order by pub_date desc nulls last, code limit 100""",
    "missing_weeks": """select snapshot_date from (
      select cast(unnest(generate_series(date '2024-11-15', date '2025-01-31', interval 7 day))
        as date) as snapshot_date) f anti join processed using (snapshot_date)""",
    "last_processed": f"""select last_processed, {NEXT_FRIDAY.format(d='last_processed')}
      as next_friday
      from (select coalesce(max(snapshot_date), date '2024-11-15') as last_processed
            from processed) p""",
    "wage_distribution": wage_distribution("listings"),
    "wage_distribution_overall": f"""select {wage_category('raw')} as wage_category,
      round(count(*) / (select count(*) from listings), 6) as proportion_overall,
      {midwage(wage_category('raw'))} as midwage_overall,
      cast(null as double) as proportion_segment, cast(null as double) as midwage_segment
      from listings group by 1, 3""",
    "wage_missing_share": wage_missing_share("listings"),
    "wage_distribution_at_rate": wage_distribution(HALF_OF_LISTINGS),
    "wage_missing_share_at_rate": wage_missing_share(HALF_OF_LISTINGS),
    "unigram_counts": "select * from unigrams",
    "bigram_counts": "select first || ' ' || second as term, n from bigrams",
    "bigram_lift": "select term, n, round(lift, 6) as lift from lifts",
    "significant_unigrams": "select * from known_unigrams",
    "significant_bigrams": "select term, n, round(lift, 6) as lift from known_bigrams",
    "phrases_export": f"""select cast({C.MIN_UNIGRAM_COUNT} as bigint) as min_unigram_count,
      cast({C.LIFT_THRESHOLD} as double) as lift_threshold, '{C.PHRASE_PATTERN}' as regex_pattern,
      (select count(*) from listings) as total_documents, u as significant_unigram_size,
      b as significant_bigram_size, u as unigrams, b as bigrams
      from (select (select count(*) from known_unigrams) as u,
                   (select count(*) from known_bigrams) as b) c""",
    "phrases_of_filtered_pairs": "select term, n, round(lift, 6) as lift from known_bigrams",
    "phrases_import": """select term, 1 as size from known_unigrams
      union all select term, 2 from known_bigrams""",
    "doc_unigrams": "select code, unigrams from features",
    "doc_bigrams": "select code, bigrams from features",
    "doc_features": "select code, ngrams from features",
    "doc_features_low_order": "select code, low_order as ngrams from features",
    "wages_and_features": "select code, wage, ngrams from features",
    "sample_validity": """select count(*) as total, count(ngrams) as valid,
      round(count(ngrams) / count(*), 6) as valid_share from features""",
    "label_counts": """select count(*) filter (wage > 0) as labelled,
      count(*) filter (wage is null) as unlabelled, count(*) filter (wage <= 0) as not_positive
      from features""",
    "labelled_samples": "select code, wage, round(log_wage, 6) as log_wage, ngrams from samples",
    "vocabulary": "select * from vocabulary",
    "vectorize": f"select * from ({vectors_of('samples', 'vocabulary')}) v",
    "run_sizes": """select (select count(*) from listings) as documents,
      (select count(*) from listings where contains(text, 'python')) as segment,
      (select count(*) from segment_samples) as labelled,
      (select count(*) from segment_vocabulary) as vocabulary,
      (select count(*) from known_unigrams) as unigrams,
      (select count(*) from known_bigrams) as bigrams""",
    "sample_listings": f"""select doc_id, raw from raw_documents
      where {hash_of('doc_id', 7)} < {int(0.1 * (1 << 60))}""",
    "take_sample": "select code, wage_info from sampled_rows where place <= 50",
    "take_sample_with_replacement": f"""select s.code, s.wage_info, d.draw
      from (select unnest(range(1, 51)) as draw) d
      join sampled_rows s
        on s.place = {hash_of("('draw' || d.draw)", 7)} % (select count(*) from listings) + 1""",
    "train_test_split": f"""select code, row_number() over (order by {hash_of('code', 42)}, code)
      <= floor(count(*) over () * 0.75) as is_train from samples""",
    "persist_folds": f"""select code, cast({hash_of('code', 42)} % 5 as integer) as fold
      from segment_samples""",
    "read_folds": f"""select s.code, s.wage, round(s.log_wage, 6) as label, v.features
      from segment_samples s
      join ({vectors_of('segment_samples', 'segment_vocabulary')}) v using (code)""",
    "split_folds_raw_wage": f"""select code, wage as label,
      row_number() over (order by {hash_of('code', 42)}, code) <= floor(count(*) over () * 0.75)
        as is_train from segment_samples""",
    "wage_by_phrase_count": """select code, round(log_wage, 4) as label,
      round(regr_intercept(log_wage, n) over () + n * regr_slope(log_wage, n) over (), 4) as prediction
      from (select code, log_wage,
              case when ngrams = '' then 0 else len(string_split(ngrams, ',')) end as n
            from samples) s""",
    "run_metadata": """select count(*) as vocabulary_size,
      (select count(*) from listings where contains(text, 'python')) as full_sample_size,
      'python' as segment_keyword, string_agg(term, ',' order by n_total desc, term) as names
      from segment_vocabulary""",
    "term_prop_doc": """select keyword, count(*) as n_docs,
      round(count(*) / (select count(*) from samples), 6) as prop_doc
      from sample_terms group by keyword""",
    "term_wage_contrast": "select * from effects",
    "effects_discovery": """select keyword, marginal_effect, round(prop_doc * 100, 4) as prop_doc
      from discovery""",
    "effects_rank": """select keyword, marginal_effect, round(prop_doc * 100, 4) as prop_doc, rank,
      14 + case when rank <= 10 then 10 - rank else 0.0 end as size,
      case when rank <= 10 then rank else 0.0 end as color
      from (select *, cast(rank() over (order by marginal_effect desc)
              + (count(*) over (partition by marginal_effect) - 1) / 2.0 as double) as rank
            from discovery) r""",
    "effects_top_abs": "select * from discovery order by abs(marginal_effect) desc, keyword limit 10",
    "regression_errors": """select l_returnflag as model, l_linestatus as split,
      round(sqrt(avg((l_extendedprice - l_quantity * 1000)
                   * (l_extendedprice - l_quantity * 1000))), 4) as rmse,
      round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) as mae
      from lineitem group by 1, 2""",
    "early_stop_epoch": """select model, min(epoch) filter (
        epoch >= 30 and (opening - val_rmse) / opening < 0.005) as stop_epoch
      from (select *, lag(val_rmse, 14) over (partition by model order by epoch) as opening
            from history) h group by model""",
    "best_epoch": """select model, epoch as best_epoch, val_rmse as best_rmse from history
      qualify row_number() over (partition by model order by val_rmse, epoch) = 1""",
    "wage_drivers_of_two_features": """select cast(1 as bigint) as inference_id,
      'all' as segment_keyword, (select count(*) from listings) as sample_size,
      cast(2 as bigint) as vocabulary_size, e.keyword,
      round(e.effect, 4) as marginal_effect, round(e.share, 6) as prop_doc
      from (select 'python' as keyword, (select slope_a from two_slopes) as effect,
              (select avg(a) from two_features where not is_train) as share
            union all select 'long', (select slope_b from two_slopes),
              (select avg(b) from two_features where not is_train)) e""",
    "commit_inference": "select * from stored",
    "effects_by_inference": "select * from stored where segment_keyword = 'logistica'",
    "effects_by_keyword": """select * from stored
      where keyword = (select min(keyword) from discovery)""",
    "cascade_delete": "select * from stored where inference_id <> 1",
    "stream_ingest": f"""select source_file, line_no, wage_info, text
      from ({standardised('valid')}) s""",
    "stream_flat_ingest": f"""select source_file, line_no, wage_info, text
      from ({standardised('flat_valid')}) s""",
    "stream_dedup": f"""select {CODE} as code, source_file, line_no, {PUB} as pub_date
      from valid where {CODE} is not null
      qualify row_number() over (partition by {CODE} order by source_file, line_no) = 1""",
}


# Date columns, which the registered queries give as ISO text.
DATES: dict[str, tuple[str, ...]] = {
    "publication_date": ("pub_date",),
    "last_friday": ("pub_date", "friday"),
    "next_friday": ("pub_date", "friday"),
    "listings_per_date": ("date",),
    "calendar_counts": ("date",),
    "calendar_of_last_days": ("date",),
    "run_last_date": ("last_date",),
    "temporal_scope": ("pub_date",),
    "capped_listings": ("pub_date",),
    "missing_weeks": ("snapshot_date",),
    "missing_weeks_of_files": ("snapshot_date",),
    "last_processed": ("last_processed", "next_friday"),
    "stream_dedup": ("pub_date",),
}


# Steps that several others refer to are worked out once.
SHARED = {"listings", "words", "unigrams", "bigrams", "known_unigrams", "known_bigrams", "kept_words",
          "kept_pairs", "features", "samples", "weekly_lines", "flat_lines", "two_features"}


def _steps_for(body: str) -> list[str]:
    """Names of the steps the body refers to, directly or not, in order of definition."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name in STEPS:
            # A relation stands after FROM, JOIN or an opening parenthesis of a subquery.
            if name not in needed and re.search(rf"\b(?:from|join)\s+{name}\b", text):
                needed.add(name)
                pending.append(STEPS[name])
    return [name for name in STEPS if name in needed]


def sql(body: str, dates: Iterable[str] = ()) -> str:
    steps = ",\n".join(
        f"{name} as {'materialized ' * (name in SHARED)}({STEPS[name]})" for name in _steps_for(body)
    )
    if dates:
        replaced = ", ".join(f"cast({d} as varchar) as {d}" for d in dates)
        body = f"select * replace ({replaced}) from ({body}) entry"
    return f"with {steps}\n{body}" if steps else body


def oracle_sql() -> dict[str, str]:
    return {name: sql(body, DATES.get(name, ())) for name, body in ENTRIES.items()}
