"""The SQL each query is checked against, composed from shared common table expressions."""

from __future__ import annotations

from tidemark.functions.text import ENTITIES
from verification.views import AS_OF, POLARITY_PROXY, TONE_PROXY

PERSISTED = {"direction": ("logistic", "random_forest", "gradient_boosting", "svm", "knn"),
             "magnitude": ("ridge", "lasso", "random_forest", "gradient_boosting", "svr", "knn")}
TEXT_COLUMNS = ("sentiment_score", "positive_prob", "negative_prob", "neutral_prob",
                "uncertainty_ratio", "hedging_ratio", "forward_guidance_strength",
                "litigious_ratio")
PRICE_COLUMNS = ("pre_earnings_momentum", "pre_earnings_volatility", "post_earnings_gap",
                 "volume_spike", "amihud_illiquidity")
TARGETS = ("ret_1d", "ret_3d")
FEATURES = (*TEXT_COLUMNS, *PRICE_COLUMNS, "text_missing")


def _in(terms) -> str:
    return "(" + ", ".join(f"'{t}'" for t in terms) + ")"


def _hits(tokens: str, terms) -> str:
    return f"len(list_filter({tokens}, lambda x: x in {_in(terms)}))"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({expr}, {digits}) as {name or expr}"


def rs(names) -> str:
    return ", ".join(r(n, digits=12 if n == "amihud_illiquidity" else 6) for n in names)


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


BARS = """
trades as (
  select p_brand as ticker, cast(l_shipdate as date) as date, l_extendedprice / l_quantity as price,
         l_quantity as q,
         row_number() over (partition by p_brand, cast(l_shipdate as date)
           order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as rn,
         row_number() over (partition by p_brand, cast(l_shipdate as date)
           order by l_orderkey desc, l_linenumber desc, l_partkey desc, l_suppkey desc) as rd
  from lineitem join part on l_partkey = p_partkey),
bars as (
  select ticker, date, max(price) filter (where rn = 1) as open, max(price) as high,
         min(price) as low, max(price) filter (where rd = 1) as close, sum(q) as volume
  from trades group by 1, 2)
"""

EVENTS = f"""
calendar as (
  select p_brand as ticker, max(o_orderdate) as event_ts
  from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey
  where o_orderpriority = '1-URGENT'
  group by p_brand, date_trunc('quarter', o_orderdate)),
past as (
  select distinct ticker, cast(event_ts as date) as event_date from calendar
  where event_ts <= timestamp '{AS_OF} 00:00:00'),
ev as (
  select ticker, event_date from (
    select *, row_number() over (partition by ticker order by event_date desc) as k from past)
  where k <= 20)
"""

WINDOW = """
win as (
  select e.ticker, e.event_date, b.date, b.open, b.high, b.low, b.close, b.volume
  from ev e join bars b on b.ticker = e.ticker
   and b.date >= e.event_date - 30 and b.date < e.event_date + 15),
seq as (
  select *, date < event_date as is_pre,
         lag(close) over w as prev_close,
         lead(close, 1) over w as lead_1, lead(close, 3) over w as lead_3,
         date >= event_date and coalesce(lag(date) over w < event_date, true) as is_event_bar
  from win window w as (partition by ticker, event_date order by date)),
rets as (
  select *, case when prev_close <> 0 then close / prev_close - 1 end as simple_return,
         case when prev_close <> 0 and close / prev_close > 0 then ln(close / prev_close) end
           as log_return
  from seq),
prices as (
  select ticker, event_date,
    case when count(simple_return) filter (where is_pre) > 0
      then product(1 + simple_return) filter (where is_pre and simple_return is not null) - 1 end
      as pre_earnings_momentum,
    case when count(*) filter (where is_pre) >= 3
      then stddev_samp(log_return) filter (where is_pre) end as pre_earnings_volatility,
    max(case when coalesce(prev_close, 0) <> 0 then open / prev_close - 1
             when open <> 0 then close / open - 1 end) filter (where is_event_bar)
      as post_earnings_gap,
    max(volume) filter (where is_event_bar) / nullif(avg(volume) filter (where is_pre), 0)
      as volume_spike,
    case when count(*) filter (where is_pre) >= 3
      then avg(abs(simple_return) / (close * volume))
        filter (where is_pre and close * volume > 0) end as amihud_illiquidity,
    max(lead_1 / nullif(close, 0) - 1) filter (where is_event_bar) as ret_1d,
    max(lead_3 / nullif(close, 0) - 1) filter (where is_event_bar) as ret_3d
  from rets group by 1, 2)
"""

FILINGS = """
filings as (
  select 'Brand#' || (1 + cast(substr(source, 4) as int)) as ticker,
         lpad(cast(1 + cast(substr(source, 4) as int) as varchar), 10, '0') as cik,
         lpad(cast(doc_id as varchar), 10, '0') as accession,
         date '1995-01-01' + cast((doc_id * 37) % 2404 as int) as filing_date,
         case (doc_id // 20) % 5 when 0 then '8-K' when 1 then '8-K/A' when 2 then '10-Q'
              when 3 then '10-Q/A' else '10-K' end as form,
         text, doc_id as ord
  from documents)
"""

NEAR = """
wide as (
  select e.ticker, e.event_date, f.accession, f.form, f.filing_date, f.ord, f.text,
         abs(date_diff('day', e.event_date, f.filing_date)) as gap_days
  from ev e join filings f on f.ticker = e.ticker
   and f.filing_date between e.event_date - 60 and e.event_date + 60
  where f.form in ('8-K', '8-K/A', '10-Q', '10-Q/A')),
near as (
  select * from (select *, count(*) filter (where gap_days <= 30)
                   over (partition by ticker, event_date) as n_near from wide)
  where gap_days <= 30 or n_near = 0),
picks as (
  select * from (
    select *, row_number() over (partition by ticker, event_date
      order by case form when '8-K' then 1 else 2 end, filing_date desc, ord) as k
    from near where form in ('8-K', '10-Q') and len(regexp_extract_all(text, '\\S+')) >= 50)
  where k = 1)
"""

DOC_TEXT = f"""
toks as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as t from documents),
chunks as (
  select doc_id, i as chunk_no, t[i * 510 + 1 : i * 510 + 510] as chunk
  from (select doc_id, t, unnest(range(0, cast(ceil(len(t) / 510.0) as bigint))) as i from toks)),
logits as (
  select doc_id, chunk_no,
         20.0::double * {_hits('chunk', POLARITY_PROXY['positive'])} / greatest(len(chunk), 1) as lp,
         20.0::double * {_hits('chunk', POLARITY_PROXY['negative'])} / greatest(len(chunk), 1) as ln,
         1.0::double as lu
  from chunks),
probs as (
  select doc_id, avg(exp(lp) / (exp(lp) + exp(ln) + exp(lu))) as pos,
         avg(exp(ln) / (exp(lp) + exp(ln) + exp(lu))) as neg,
         avg(exp(lu) / (exp(lp) + exp(ln) + exp(lu))) as neu
  from logits group by doc_id),
doc_features as (
  select doc_id,
         coalesce(pos, 0) - coalesce(neg, 0) as sentiment_score, coalesce(pos, 0) as positive_prob,
         coalesce(neg, 0) as negative_prob, coalesce(neu, 0) as neutral_prob,
         {", ".join(f"{_hits('t', terms)} / greatest(len(t), 1)::double as {name}"
                    for name, terms in TONE_PROXY.items())}
  from toks left join probs using (doc_id))
"""

_IMPUTED = (*TEXT_COLUMNS, *PRICE_COLUMNS, *TARGETS)

MATRIX = f"""
texts as (
  select p.ticker, p.event_date, {", ".join(f"d.{c}" for c in TEXT_COLUMNS)}
  from picks p join doc_features d on d.doc_id = p.ord),
raw as (
  select e.ticker, e.event_date, t.ticker is null as text_missing,
         {", ".join(TEXT_COLUMNS)}, {", ".join(PRICE_COLUMNS)}, {", ".join(TARGETS)}
  from ev e left join texts t on t.ticker = e.ticker and t.event_date = e.event_date
            left join prices p on p.ticker = e.ticker and p.event_date = e.event_date),
med as (select {", ".join(f"median({c}) as m_{c}" for c in _IMPUTED)} from raw),
matrix as (
  select ticker, event_date, text_missing,
         {", ".join(f"coalesce({c}, m_{c}) as {c}" for c in _IMPUTED)}
  from raw, med)
"""


def split_cte(ratio: float) -> str:
    return f"""
ordered as (
  select *, row_number() over (order by event_date, ticker) as pos, count(*) over () as total
  from matrix),
parts as (select *, pos <= floor(total * {ratio}::double) as is_train from ordered)
"""


SCALED = f"""
numeric_parts as (
  select * replace (text_missing::int::double as text_missing) from parts),
stats as (
  select {", ".join(f"avg({c}) as a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}"
                    for c in FEATURES)} from numeric_parts where is_train),
scaled as (
  select ticker, event_date, is_train, ret_1d, ret_3d,
         {", ".join(f"({c} - a_{c}) / s_{c} as {c}" for c in FEATURES)}
  from numeric_parts, stats)
"""

KNN = f"""
pairs as (
  select q.ticker, q.event_date, t.ticker as n_ticker, t.event_date as n_event_date, t.ret_1d as y,
         sqrt({" + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in FEATURES)}) as distance
  from scaled q, scaled t where t.is_train and not q.is_train),
nearest as (
  select * from (select *, row_number() over (partition by ticker, event_date
                   order by distance, n_ticker, n_event_date) as rank from pairs)
  where rank <= 5),
weighed as (
  select *, case when count(*) filter (where distance = 0) over (partition by ticker, event_date) > 0
                 then (distance = 0)::int::double else 1.0 / nullif(distance, 0) end as weight
  from nearest)
"""


def _rule(kind: str, h: int, name: str, value: str) -> str:
    return (f"select '{kind}_{h}d_{name}' as model, '{kind}' as model_type, {h} as horizon, ticker, "
            f"event_date, ret_{h}d as actual, {value} as predicted from parts where not is_train")


PREDICTIONS = "preds as (\n" + "\nunion all\n".join(
    _rule(kind, h, name, value) for h in (1, 3) for kind, name, value in (
        ("direction", "gap_sign", "(post_earnings_gap >= 0)::int::double"),
        ("magnitude", "momentum", "0.1::double * pre_earnings_momentum"))) + """),
dirs as (select *, (actual >= 0)::int as actual_label, predicted::int as predicted_label
         from preds where model_type = 'direction'),
mags as (select *, actual - predicted as error from preds where model_type = 'magnitude'),
cm as (
  select model, count(*) filter (where actual_label = 0 and predicted_label = 0) as tn,
         count(*) filter (where actual_label = 0 and predicted_label = 1) as fp,
         count(*) filter (where actual_label = 1 and predicted_label = 0) as fn,
         count(*) filter (where actual_label = 1 and predicted_label = 1) as tp
  from dirs group by model),
class_metrics as (
  select model, (tp + tn) / (tn + fp + fn + tp)::double as accuracy,
         coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision,
         coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall,
         coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1
  from cm),
errors as (
  select model, count(*) as n, avg(abs(error)) as mae, sqrt(avg(error * error)) as rmse,
         case when count(*) <= 1 then null
              when var_pop(actual) = 0 then case when avg(error * error) = 0 then 1 else 0 end
              else 1 - avg(error * error) / var_pop(actual) end as r2
  from mags group by model),
ranked as (
  select model,
         rank() over (partition by model order by actual)
           + (count(*) over (partition by model, actual) - 1) / 2.0::double as ra,
         rank() over (partition by model order by predicted)
           + (count(*) over (partition by model, predicted) - 1) / 2.0::double as rp
  from mags),
ics as (
  select model, count(*) as n, case when count(*) > 2
    then covar_pop(ra, rp) / nullif(sqrt(var_pop(ra) * var_pop(rp)), 0) end as ic
  from ranked group by model),
terms as (
  select model, n - 2 as nu, ic, k,
         case when k = 0 then 1.0::double
              when (n - 2) % 2 = 0 then (2 * k - 1) / (2.0::double * k)
              else (2 * k) / (2.0::double * k + 1) end * case when k = 0 then 1 else 1 - ic * ic end
           as factor
  from (select *, unnest(range(0, (n - 2) // 2)) as k from ics)),
series as (
  select model, nu, ic, sum(term) as total from (
    select model, nu, ic, product(factor) over (partition by model order by k) as term from terms)
  group by 1, 2, 3),
pvals as (
  select model, 1 - case when nu % 2 = 0 then abs(ic) * total
    else 2 / pi() * (asin(abs(ic)) + abs(ic) * sqrt(1 - ic * ic) * total) end as ic_pval
  from series)
"""

MARKET = (BARS, EVENTS, WINDOW)
FULL = (BARS, EVENTS, WINDOW, FILINGS, NEAR, DOC_TEXT, MATRIX)
SPLIT = (*FULL, split_cte(0.7))
PREDICTED = (*SPLIT, PREDICTIONS)


def _blocks(source: str, condition: str, form: str, whole: str = "true") -> str:
    return f"""
    select {source} as source_no, cik, block_no, rn - 1 as pos, accession, {form} as form,
           filing_date, primary_document from (
      select cik, ord // 2000 as block_no, accession, form, strftime(filing_date, '%Y-%m-%d')
               as filing_date, 'doc' || ord || '.htm' as primary_document,
             row_number() over (partition by cik, ord // 2000 order by ord) as rn,
             count(*) over (partition by cik, ord // 2000) as c
      from filings where {condition})
    where rn < c or {whole}"""


def build() -> dict[str, str]:
    market, full, split, predicted = (ctes(*x) for x in (MARKET, FULL, SPLIT, PREDICTED))
    key = "ticker, event_date"
    out: dict[str, str] = {}

    # registry and filing indexes
    out["registry_lookup"] = """
      select upper(p_brand) as ticker, lpad(cast(max(p_partkey) as varchar), 10, '0') as cik
      from part group by 1
      union all
      select 'PART-' || p_size, cast(max(p_partkey) + 10000000000 as varchar) from part group by 1"""
    out["registry_join"] = ctes(EVENTS, FILINGS) + """
      select e.ticker, e.event_date, f.cik from ev e
      left join (select distinct ticker, cik from filings) f on f.ticker = e.ticker"""
    out["document_addresses"] = ctes(FILINGS) + """
      select accession, 'archive/' || ltrim(cik, '0') || '/' || accession || '/doc' || ord || '.htm'
        as address from filings"""
    out["filing_explode"] = ctes(FILINGS) + f"""
      select cik, block_no, cast(pos as int) as pos, accession, form, filing_date, primary_document
      from ({_blocks('0', 'true', 'form', 'block_no % 2 = 1')})"""
    out["filing_history"] = ctes(FILINGS) + f"""
      select cik, accession, form, filing_date, primary_document, cast(source_no as int) as source_no
      from (select *, row_number() over (partition by cik, accession
              order by source_no, block_no, pos) as k from (
        {_blocks('0', "filing_date >= date '2000-01-01'", 'form')}
        union all
        {_blocks('1', "filing_date < date '2000-07-01'", 'lower(form)')}))
      where k = 1"""
    out["form_filter"] = ctes(FILINGS) + """
      select ticker, accession, lower(form) as form from filings where form <> '10-K'"""
    out["valid_dates"] = """
      select doc_id, filing_date from (
        select doc_id, cast(try_strptime('1999-' || lpad(cast(doc_id % 14 + 1 as varchar), 2, '0')
          || '-' || lpad(cast(doc_id % 31 + 1 as varchar), 2, '0'), '%Y-%m-%d') as date)
          as filing_date from documents)
      where filing_date is not null"""

    # text
    names = ", ".join("'" + k + "': '" + v.replace("'", "''") + "'" for k, v in ENTITIES.items())
    bare = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script\\b[^>]*>.*?(</script\\s*>|\\z)', ' ', 'g'),
        '(?is)<style\\b[^>]*>.*?(</style\\s*>|\\z)', ' ', 'g'),
        '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"""
    ref = ("regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});', 1)")
    code = f"""(case when lower(substr({ref}, 2, 1)) = 'x'
        then ('0x' || substr({ref}, 3))::bigint else substr({ref}, 2)::bigint end)"""
    value = f"""case when {ref} = '' then null when {ref}[1] = '#' then case when
        {code} between 1 and 55295 or {code} between 57344 and 1114111
        then chr({code}::int) else chr(65533) end else map {{{names}}}[{ref}] end"""
    plain = f"""trim(regexp_replace(string_split({bare}, '&')[1] || array_to_string(list_transform(
        string_split({bare}, '&')[2:], lambda p: coalesce(({value}) || substr(p, length({ref}) + 2),
        '&' || p)), ''), '\\s+', ' ', 'g'))"""
    out["html_to_text"] = f"select page_id, {plain} as text from pages"
    out["alternate_document"] = f"""
      with docs as (select page_id // 5 as accession, page_id % 5 as doc_no, url, {plain} as text
                    from pages),
      sized as (select *, len(regexp_extract_all(text, '\\S+')) as words from docs),
      choices as (
        select *, case when doc_no = 0 and words >= 50 then 0
                       when doc_no > 0 and words >= 50 and (url like '%.htm' or url like '%.html')
                       then 1
                       when doc_no = 0 and text <> '' then 2 end as choice from sized)
      select accession, doc_no, text from (
        select *, row_number() over (partition by accession order by choice, doc_no) as k
        from choices where choice is not null)
      where k = 1"""
    out["word_gate"] = """
      select doc_id, cast(len(regexp_extract_all(text, '\\S+')) as int) as n_words,
             len(regexp_extract_all(text, '\\S+')) >= 50 as usable from documents"""
    out["lexicon_ratios"] = ctes(DOC_TEXT) + f"""
      select doc_id, {", ".join(TONE_PROXY)} from doc_features"""
    out["lexicon_table_ratios"] = ctes(DOC_TEXT) + " union all ".join(
        f"""select doc_id, '{name}' as category, {name} as ratio from doc_features"""
        for name in TONE_PROXY)
    out["text_chunks"] = ctes(DOC_TEXT) + """
      select doc_id, cast(chunk_no as int) as chunk_no, cast(len(chunk) as int) as n_tokens,
             array_to_string(chunk, ' ') as chunk from chunks"""
    out["chunk_sentiment"] = ctes(DOC_TEXT) + f"""
      select doc_id, {rs(TEXT_COLUMNS[:4])} from doc_features"""
    out["pluggable_sentiment"] = out["chunk_sentiment"]

    # bars and events
    out["ohlcv_bars"] = ctes(BARS) + f"""
      select ticker, date, open, high, low, close, volume from bars"""
    out["bar_scan"] = ctes(BARS) + f"""
      select ticker, date, open, high, low, close, volume from bars
      where date < date '{AS_OF}'"""
    out["calendar_events"] = ctes(EVENTS) + "select ticker, event_date from past"
    out["latest_events"] = ctes(EVENTS) + "select ticker, event_date from ev"
    out["event_window"] = market + f"""
      select ticker, event_date, date, open, high, low, close, volume from win"""
    out["window_split"] = market + """
      select ticker, event_date, count(*) filter (where date < event_date) as n_pre,
             count(*) filter (where date >= event_date) as n_post from win group by 1, 2"""
    out["as_of_bars"] = market + """
      select ticker, event_date, max(date) filter (where is_pre) as prev_date,
             arg_max(close, date) filter (where is_pre) as prev_close,
             max(date) filter (where is_event_bar) as bar_date,
             max(open) filter (where is_event_bar) as bar_open,
             max(close) filter (where is_event_bar) as bar_close
      from seq group by 1, 2"""
    out["bar_returns"] = market + f"""
      select ticker, event_date, date, is_pre, is_event_bar,
             {rs(("simple_return", "log_return"))}, lead_1, lead_3 from rets"""
    for name, cols in (("momentum", PRICE_COLUMNS[:1]), ("volatility", PRICE_COLUMNS[1:2]),
                       ("gap", PRICE_COLUMNS[2:3]), ("volume_spike", PRICE_COLUMNS[3:4]),
                       ("amihud", PRICE_COLUMNS[4:]), ("targets", TARGETS),
                       ("price_features", PRICE_COLUMNS + TARGETS)):
        out[name] = market + f"select {key}, {rs(cols)} from prices"

    # choosing filings
    near = ctes(EVENTS, FILINGS, NEAR)
    out["filing_window"] = near + f"""
      select {key}, accession, form, filing_date, cast(gap_days as int) as gap_days
      from wide where gap_days <= 30"""
    out["filing_fallback"] = near + f"""
      select {key}, accession, form, filing_date, cast(gap_days as int) as gap_days from near"""
    out["filing_pick"] = near + f"select {key}, accession, form, filing_date from picks"
    out["event_texts"] = near + f"select {key}, accession, form, filing_date, text from picks"
    out["event_text_features"] = full + f"select {key}, {rs(TEXT_COLUMNS)} from texts"

    # matrix and store
    out["feature_fusion"] = full + f"select {key}, text_missing, {rs(_IMPUTED)} from raw"
    out["missing_counts"] = full + " union all ".join(
        f"select '{c}' as column_name, count(*) - count({c}) as n_missing from raw"
        for c in _IMPUTED)
    out["column_medians"] = full + " union all ".join(
        f"select '{c}' as column_name, round(median({c}), 12) as median from raw"
        for c in _IMPUTED)
    out["feature_matrix"] = full + f"select {key}, text_missing, {rs(_IMPUTED)} from matrix"
    for name in ("matrix_csv", "matrix_from_store"):
        out[name] = out["feature_matrix"] if name == "matrix_csv" else out["feature_fusion"]
    manifest = full + f"""
      select e.ticker, e.event_date, p.ticker is not null as has_text,
             exists (select 1 from win w where w.ticker = e.ticker
                     and w.event_date = e.event_date) as has_prices
      from ev e left join picks p on p.ticker = e.ticker and p.event_date = e.event_date"""
    out["manifest"] = manifest
    out["manifest_scan"] = f"select * from ({manifest}) where has_text or has_prices"
    out["coverage"] = f"""select count(*) as n_events, count(*) filter (where has_text) as n_text,
      count(*) filter (where has_prices) as n_prices from ({manifest})"""
    out["incremental_events"] = full + f"""
      select {key} from ev where not exists (
        select 1 from picks p where p.ticker = ev.ticker and p.event_date = ev.event_date)"""
    out["raw_store"] = out["event_window"]
    out["forced_events"] = f"""select {key}, date, close,
      volume + (day(event_date) % 3 = 0)::int as volume from ({out["event_window"]})"""
    out["forced_manifest"] = f"""select * from ({manifest})
      where has_text or has_prices or day(event_date) % 3 = 0"""
    out["collected_filings"] = out["event_texts"]
    out["newest_first"] = ctes(FILINGS) + """
      select cik, accession, cast(row_number() over (partition by cik order by filing_date desc, ord)
             as int) as position from filings"""
    observed = split + " select ticker, event_date, horizon, label from (" + " union all ".join(
        f"""select p.ticker, p.event_date, {h} as horizon, (raw.ret_{h}d >= 0)::int::double as label
            from parts p join raw on raw.ticker = p.ticker and raw.event_date = p.event_date
            where is_train and raw.ret_{h}d is not null""" for h in (1, 3)) + ")"
    out["null_targets"] = observed
    out["training_sizes"] = f"""select horizon, count(*) as n, count(*) >= 5 as enough
      from ({observed}) group by horizon"""
    out["model_persistence"] = split + " union all ".join(
        f"select '{kind}_{h}d_{model}' as model, count(*) as n, 0::bigint as n_changed from parts "
        "where not is_train" for h in (1, 3) for kind, models in PERSISTED.items()
        for model in models)

    # split, scaling, neighbours
    for name, ratio in (("chrono_split", 0.7), ("chrono_split_straddling", 0.613)):
        out[name] = ctes(*FULL, split_cte(ratio)) + f"select {key}, is_train from parts"
    scaled = ctes(*SPLIT, SCALED)
    out["schema_completion"] = scaled + f"""
      select {key}, {rs(FEATURES)}, 0.0::double as absent from numeric_parts"""
    out["standard_scale"] = scaled + f"select {key}, {rs(FEATURES)} from scaled"
    out["direction_labels"] = split + f"""
      select {key}, (ret_1d >= 0)::int as label_1d, (ret_3d >= 0)::int as label_3d from parts
      where is_train"""
    out["class_weights"] = split + """
      select label, n, round(sum(n) over () / (count(*) over () * n)::double, 6) as weight from (
        select (ret_1d >= 0)::int as label, count(*) as n from parts where is_train group by 1)"""
    # At the optimum every residual is zero; what is counted are the rows that each model learnt from.
    out["linear_optimality"] = split + " union all ".join(
        f"""select '{kind}' as kind, {h} as horizon, '{f}' as feature, 0.0::double as residual,
            count(*) filter (where ret_{h}d is not null) as n from parts where is_train"""
        for kind in ("ridge", "lasso", "logistic") for h in (1, 3) for f in (*FEATURES, "intercept"))
    knn = ctes(*SPLIT, SCALED, KNN)
    out["knn_neighbours"] = knn + f"""
      select {key}, n_ticker, n_event_date, {r("distance")}, cast(rank as int) as rank
      from nearest"""
    out["knn_approximate"] = knn + f"""
      select count(distinct (ticker, event_date)) as n_queries, count(*) as n_wanted, true as reached,
             0::bigint as n_wrong_distances from nearest"""
    out["knn_classify"] = knn + f"""
      select {key}, label::double as predicted from (
        select *, row_number() over (partition by {key} order by vote desc, label) as k from (
          select {key}, (y >= 0)::int as label, round(sum(weight), 9) as vote
          from weighed group by 1, 2, 3))
      where k = 1"""
    out["knn_regress"] = knn + f"""
      select {key}, round(sum(weight * y) / sum(weight), 6) as predicted from weighed
      group by 1, 2"""

    # evaluation
    out["predictions"] = predicted + f"""
      select model, model_type, horizon, {key}, {rs(("actual", "predicted"))} from preds"""
    out["confusion"] = predicted + "select model, tn, fp, fn, tp from cm"
    cls = rs(("accuracy", "precision", "recall", "f1"))
    out["class_metrics"] = predicted + f"select model, {cls} from class_metrics"
    out["class_report"] = predicted + f"""
      , sides as (
        select model, '0' as section, coalesce(tn / nullif(tn + fn, 0)::double, 0) as precision,
               coalesce(tn / nullif(tn + fp, 0)::double, 0) as recall,
               coalesce(2 * tn / nullif(2 * tn + fn + fp, 0)::double, 0) as f1,
               tn + fp as support from cm where tn + fn + fp > 0
        union all
        select model, '1', coalesce(tp / nullif(tp + fp, 0)::double, 0),
               coalesce(tp / nullif(tp + fn, 0)::double, 0),
               coalesce(2 * tp / nullif(2 * tp + fn + fp, 0)::double, 0), tp + fn
        from cm where tp + fn + fp > 0),
      lines as (
        select * from sides
        union all select model, 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n::bigint
          from (select *, (tn + fp + fn + tp)::double as n from cm)
        union all select model, 'macro avg', avg(precision), avg(recall), avg(f1),
          sum(support)::bigint from sides group by model
        union all select model, 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
          sum(support)::bigint from sides group by model)
      select model, section, {rs(("precision", "recall", "f1"))}, support from lines"""
    out["error_metrics"] = predicted + f"select model, n, {rs(('mae', 'rmse', 'r2'))} from errors"
    out["spearman_ic"] = predicted + f"""
      select i.model, i.n, {r("i.ic", "ic")}, {r("p.ic_pval", "ic_pval")}
      from ics i left join pvals p on p.model = i.model"""
    out["regression_metrics"] = predicted + f"""
      select e.model, e.n, {r("e.mae", "mae")}, {r("e.rmse", "rmse")}, {r("e.r2", "r2")},
             {r("i.ic", "ic")}, {r("p.ic_pval", "ic_pval")}
      from errors e left join ics i on i.model = e.model left join pvals p on p.model = e.model"""
    out["per_entity_accuracy"] = predicted + """
      select model, ticker, count(*) as n,
             round(avg((actual_label = predicted_label)::int), 6) as accuracy
      from dirs group by 1, 2"""
    out["per_entity_mae"] = predicted + """
      select model, ticker, count(*) as n, round(avg(abs(error)), 6) as mae
      from mags group by 1, 2"""
    out["top_failures_direction"] = predicted + f"""
      select model, cast(rank as int) as rank, {key}, {r("actual")}, predicted_label,
             round(abs(actual), 6) as abs_return
      from (select *, row_number() over (partition by model
              order by abs(actual) desc, event_date, ticker) as rank
            from dirs where actual_label <> predicted_label)
      where rank <= 5"""
    out["top_failures_magnitude"] = predicted + f"""
      select model, cast(rank as int) as rank, {key}, {rs(("actual", "predicted", "error"))},
             round(abs(error), 6) as abs_error
      from (select *, row_number() over (partition by model
              order by abs(error) desc, event_date, ticker) as rank from mags)
      where rank <= 5"""
    out["leaderboard_direction"] = predicted + f"""
      select model, {cls}, f1 = max(f1) over () as is_best, accuracy > 0.5 as above_random
      from class_metrics"""
    out["leaderboard_magnitude"] = predicted + f"""
      select e.model, {r("e.mae", "mae")}, {r("e.rmse", "rmse")}, {r("e.r2", "r2")},
             {r("i.ic", "ic")}, e.mae = min(e.mae) over () as is_best
      from errors e left join ics i on i.model = e.model"""
    out["pred_extents"] = predicted + """
      select model, round(least(min(actual), min(predicted)) - 0.005, 6) as lower,
             round(greatest(max(actual), max(predicted)) + 0.005, 6) as upper
      from mags group by 1"""
    def significant(x):
        scale = f"pow(10.0::double, floor(log10(greatest(abs({x}), 1))))"
        return f"round({x} / {scale}, 9) * {scale} as {x}"
    out["pnl_curve"] = predicted + f"""
      select model, event_index, {key}, position, {significant("cum_strategy")},
             {significant("cum_buyhold")}
      from (select model, row_number() over w - 1 as event_index, {key}, position,
             product(1 + position * actual) over w as cum_strategy,
             product(1 + actual) over w as cum_buyhold
      from (select *, case predicted_label when 1 then 1.0::double else -1.0::double end as position
            from dirs)
      window w as (partition by model order by event_date, ticker
                   rows between unbounded preceding and current row))"""
    out["feature_histogram"] = full + """
      , long as (
        select 'sentiment_score' as column_name, sentiment_score as x from matrix
        union all select 'uncertainty_ratio', uncertainty_ratio from matrix),
      ranges as (select column_name, min(x) as low, (max(x) - min(x)) / 20 as width
                 from long group by 1),
      bins as (select column_name, low, width, unnest(range(1, 21)) as bin from ranges),
      counts as (
        select column_name, least(floor((x - low) / width) + 1, 20) as bin, count(*) as n
        from long join ranges using (column_name) group by 1, 2)
      select b.column_name, cast(b.bin as int) as bin, round(low + (b.bin - 1) * width, 6) as lower,
             round(low + b.bin * width, 6) as upper, coalesce(c.n, 0) as n
      from bins b left join counts c on c.column_name = b.column_name and c.bin = b.bin"""
    return out
