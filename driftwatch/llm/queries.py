"""The registered queries of the corpus operators."""

from pyspark.sql import functions as F

from driftwatch.llm import warc
from driftwatch.llm.chat import digests, formatted
from driftwatch.llm.copies import exact_duplicates
from driftwatch.llm.decontaminate import leaks
from driftwatch.llm.html import extract, learn
from driftwatch.llm.language import fit as fit_languages
from driftwatch.llm.language import languages
from driftwatch.llm.minhash import near_duplicates
from driftwatch.llm.mixing import mixture
from driftwatch.llm.negatives import hard_negatives, integer_vectors
from driftwatch.llm.personal import digests as span_digests
from driftwatch.llm.personal import find
from driftwatch.llm.personal import fit as fit_spans
from driftwatch.llm.phrases import collocations
from driftwatch.llm.quality import quality
from driftwatch.llm.registry import ORACLES, QUERIES, query, table
from driftwatch.llm.repeats import without_repeats
from driftwatch.storage import new_path

__all__ = ["ORACLES", "QUERIES"]


@query()
def op1_minhash(spark, sf_dir):
    """Near-duplicate groups of whole documents: three-word shingles, similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85, den=100)


@query("""
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
""")
def op2_exact_dedup(spark, sf_dir):
    """Exact copies of whole documents; the largest doc_id stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


@query()
def op3_quality(spark, sf_dir):
    """Quality of every document by a sparse ensemble of rules."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op4_language(spark, sf_dir):
    """Language of every document: family, then one-versus-one machines."""
    docs = table(spark, sf_dir, "documents")
    return languages(docs, fit_languages(docs))


@query()
def op5_decontamination(spark, sf_dir):
    """Every document and benchmark item found in it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), d as (
  select *, regexp_replace(text, '([\[<])(\\*)(/?(?:SYS|INST|ROLE)\]|OUT\]|/s>)', '\1\\\2\3', 'g') as told,
         case role when 'system' then 13 when 'user' then 15 else 11 end as around
  from c
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
       cast(sum(length(told) + around) as bigint) as formatted_chars
from d group by conv_id
""")
def op6_chat(spark, sf_dir):
    """Every conversation and one made of control strings, formatted and read back."""
    more = spark.sql(r"""select -7L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text
                         from values (0L, 'user'), (1L, 'assistant') as t(turn, role)""")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(formatted(chats))


# fixed choices of the registered mixture; names that are not given weigh 1
DOMAIN_WEIGHTS = {"web": 4, "books": 3, "news": 2, "forum": 1}
LANGUAGE_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}
SHARE, EPOCHS, SEED = (3, 5), 2, 1


def domain():
    """The domain of a source: its number's remainder by 4."""
    number = F.expr("try_cast(substring(source, 4) as int)")
    return F.coalesce(F.get(F.array(*map(F.lit, DOMAIN_WEIGHTS)), F.pmod(number, F.lit(4))), F.lit("other"))


def mix(docs):
    return mixture(docs, domain(), DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS, SHARE, EPOCHS, SEED)


def mixture_sql() -> str:
    def case(column, given):
        return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in given.items()) + " else 1 end"

    def level(k):
        names = ["root", "domain", "language", "origin"]
        parent, child = ", ".join(names[:k]), names[k]
        given = (DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS)[k - 1]
        order = f"partition by {parent} order by capacity / weight, {child}"
        return f"""
c{k} as (select {parent}, {child}, cast(sum(capacity) as hugeint) as capacity, cast({case(child, given)} as hugeint) as weight
         from leaves group by {parent}, {child} having sum(capacity) > 0),
w{k} as (select c{k}.*, greatest(given - coalesce(sum(capacity) over ({order} rows between unbounded preceding and 1 preceding), 0), 0) as rest,
                sum(weight) over ({order} rows between current row and unbounded following) as remaining
         from c{k} join b{k - 1} using ({parent})),
f{k} as (select *, case when capacity * remaining <= rest * weight then null
                        else row_number() over ({order}) end as stop from w{k}),
s{k} as (select *, min(stop) over ({order} rows between unbounded preceding and current row) as first_stop,
                row_number() over ({order}) as place from f{k}),
b{k} as (select s.{parent.replace(', ', ', s.')}, s.{child},
                case when s.first_stop is null then s.capacity
                     else least(s.capacity, (t.rest * s.weight) // t.remaining) end as given
         from s{k} s left join s{k} t on {' and '.join(f's.{x} = t.{x}' for x in names[:k])} and t.place = s.first_stop),"""

    return rf"""
with docs as (
  select doc_id, coalesce(lang, '') as language, coalesce(source, '') as origin,
         coalesce((['web', 'books', 'news', 'forum'])[cast(try_cast(substr(source, 4) as int) % 4 as int) + 1], 'other') as domain,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as n_tokens
  from documents
), leaves as (
  select 0 as root, domain, language, origin, sum(n_tokens) as available, sum(n_tokens) * {EPOCHS} as capacity
  from docs group by domain, language, origin
), b0 as (
  select 0 as root, least(sum(capacity), (sum(available) * {SHARE[0]}) // {SHARE[1]}) as given from leaves
), {level(1)} {level(2)} {level(3)} plan as (
  select domain, language, origin, given // available as whole, given - (given // available) * available as rest
  from b3 join leaves using (root, domain, language, origin) where given > 0
), ordered as (
  select doc_id, domain, language, origin, n_tokens, whole, rest,
         sum(n_tokens) over (partition by domain, language, origin
                             order by md5('{SEED}:' || (whole + 1) || ':' || coalesce(cast(doc_id as varchar), '')), n_tokens, doc_id
                             rows between unbounded preceding and current row) as running
  from docs join plan using (domain, language, origin)
)
select doc_id, cast(whole + 1 as bigint) as epoch, domain, language, origin, n_tokens from ordered where rest > 0 and running <= rest
union all
select doc_id, cast(e.epoch as bigint), domain, language, origin, n_tokens
from ordered join (select unnest(range(1, {EPOCHS + 1})) as epoch) e on e.epoch <= whole
"""


@query(mixture_sql())
def op7_mixing(spark, sf_dir):
    """Documents taken, by epoch, for target weights of domains, languages and sources."""
    return mix(table(spark, sf_dir, "documents"))


@query()
def op8_html(spark, sf_dir):
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, learn(pages))


@query()
def op10_personal(spark, sf_dir):
    """Personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return span_digests(find(docs, fit_spans(docs)))


def captures(pages):
    """WARC records of the pages: a response of each, and a revisit 90 days later, by kinds of validators.

    By page_id modulo 5 the revisit repeats the tag (0, 1), has another tag (2), repeats the time only (3) or has neither (4); by
    modulo 7 = 0 it is a day before the response instead.
    """
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60)
    tag = F.concat(F.lit("ETag: \""), F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16))
    time = F.concat(F.lit("Last-Modified: day "), (F.col("page_id") % 1000).cast("string"))
    kind = F.pmod("page_id", F.lit(5))
    response = pages.select(
        F.concat(F.lit("urn:page:"), "page_id", F.lit(":response")).alias("record_id"), F.lit("response").alias("type"),
        "url", day.alias("date"), F.array(F.lit("Content-Type: application/http; msgtype=response")).alias("extra"),
        F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html"), F.when(kind != 3, F.concat(tag, F.lit("\""))),
                    time, F.lit("Date: first"), F.lit(""), F.coalesce("html", F.lit(""))).alias("block"))
    revisit = pages.select(
        F.concat(F.lit("urn:page:"), "page_id", F.lit(":revisit")).alias("record_id"), F.lit("revisit").alias("type"),
        F.concat(F.col("url"), F.lit("#again")).alias("url"),
        F.when(F.pmod("page_id", F.lit(7)) == 0, day - F.expr("interval 1 day")).otherwise(day + F.expr("interval 90 days")).alias("date"),
        F.array(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified")).alias("extra"),
        F.concat_ws("\r\n", F.lit("HTTP/1.1 304 Not Modified"), F.lit("Content-Type: text/none"), F.lit("Date: second"),
                    F.when(kind < 2, F.concat(tag, F.lit("\""))).when(kind == 2, F.concat(tag, F.lit("x\""))),
                    F.when(kind == 3, time), F.lit("Connection: close"), F.lit("Cache-Control: max-age=60"), F.lit(""), F.lit("")).alias("block"))
    return response.unionByName(revisit)


@query(r"""
with keyed as (
  select page_id, url, html, 1704067200 + page_id * 60 as moment, page_id % 5 as kind,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i:https?)://', '') as bare
  from pages
), parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '') as host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(/index\.html?)?/*$', '') as path,
         list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'), lambda p: p <> '' and not
                   regexp_matches(p, '^(?i:utm_[^=&]*|gclid|fbclid|ref|sessionid|phpsessid|jsessionid)(=|$)'))) as params
  from keyed
), named as (
  select page_id, html, moment, kind, host || path || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as key,
         case when page_id % 7 = 0 then moment - 86400 else moment + 7776000 end as again,
         substr(sha256(coalesce(html, '')), 1, 16) as tag, page_id % 1000 as modified
  from parts
), paired as (
  select r.page_id, r.kind, r.tag, r.modified, b.page_id as base, b.kind as base_kind, b.tag as base_tag,
         b.modified as base_modified, b.html as base_html,
         row_number() over (partition by r.page_id order by b.moment desc nulls last, 'urn:page:' || b.page_id desc) as place
  from named r left join named b on b.key = r.key and b.moment < r.again
), judged as (
  select *, case when base is null then 'no base'
                 when base_kind <> 3 and kind < 2 then case when tag = base_tag then 'etag' else 'conflict' end
                 when base_kind <> 3 and kind = 2 then 'conflict'
                 when kind = 3 then case when modified = base_modified then 'last-modified' else 'conflict' end
                 else 'unverified' end as outcome
  from paired where place = 1
)
select cast(page_id as bigint) as page_id, outcome,
       case when outcome in ('etag', 'last-modified') then cast(base as bigint) end as base_page_id,
       case when outcome in ('etag', 'last-modified') then sha256(coalesce(base_html, '')) end as payload_sha256,
       case outcome when 'etag' then 'content-type=text/html;last-modified=day ' || base_modified || ';date=second;etag="' || tag || '";cache-control=max-age=60'
                    when 'last-modified' then 'content-type=text/html;' || case when base_kind <> 3 then 'etag="' || base_tag || '";' else '' end ||
                                              'date=second;last-modified=day ' || modified || ';cache-control=max-age=60' end as http
from judged
""")
def op9_warc(spark, sf_dir):
    """Every revisit of an archive of the pages, written and read as WARC, completed from its earlier response."""
    path = new_path(spark, "warc")
    warc.write(captures(table(spark, sf_dir, "pages")), path)
    out = warc.resolve(warc.read(spark, path))
    number = lambda c: F.regexp_extract(c, "urn:page:(-?[0-9]+):", 1).try_cast("long")
    http = F.array_join(F.transform("http", lambda f: F.concat(f["name"], F.lit("="), f["value"])), ";")
    return out.select(number("record_id").alias("page_id"), "outcome", number("base_id").alias("base_page_id"),
                      "payload_sha256", http.alias("http"))


@query("""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as x
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as vec_id, a.label = b.label as same, cast(list_inner_product(a.x, b.x) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
), negatives as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
       and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 3
""")
def op12_hard_negatives(spark, sf_dir):
    """Hard negatives of every fiftieth vector against all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(integer_vectors(rows.withColumn("label", moved)), F.col("vec_id") % 50 == 0)


@query(r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), f1 as (
  select lang, word, count(*) as f from (select lang, unnest(w) as word from w) group by all
), n as (
  select lang, sum(f) as n from f1 group by lang
), f2 as (
  select lang, g[1] as w1, g[2] as w2, count(*) as f
  from (select lang, unnest(list_transform(range(1, len(w)), lambda k: w[k:k + 1])) as g from w where len(w) > 1) group by all having count(*) >= 10
), f3 as (
  select lang, g[1] as w1, g[2] as w2, g[3] as w3, count(*) as f
  from (select lang, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k:k + 2])) as g from w where len(w) > 2) group by all having count(*) >= 10
), cuts as (
  select p.lang, w1 || ' ' || w2 as phrase, 1 as k, p.f as a, x.f as l, y.f as r
  from f2 p join f1 x on x.lang = p.lang and x.word = w1 join f1 y on y.lang = p.lang and y.word = w2
  where not exists (select 1 from f3 t where t.lang = p.lang and 100 * t.f >= 50 * p.f
                    and (t.w1 = p.w1 and t.w2 = p.w2 or t.w2 = p.w1 and t.w3 = p.w2))
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 1, t.f, x.f, p.f
  from f3 t join f1 x on x.lang = t.lang and x.word = t.w1 join f2 p on p.lang = t.lang and p.w1 = t.w2 and p.w2 = t.w3
  union all
  select t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, 2, t.f, p.f, x.f
  from f3 t join f1 x on x.lang = t.lang and x.word = t.w3 join f2 p on p.lang = t.lang and p.w1 = t.w1 and p.w2 = t.w2
), scored as (
  select *, cast((cast(1000000 as hugeint) * a * a) // (cast(l as hugeint) * r) as bigint) as score from cuts
), lowest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, score
from lowest join n using (lang) qualify rank <= 2000
""")
def op13_phrases(spark, sf_dir):
    """The strongest collocations of two or three words in every language."""
    return collocations(table(spark, sf_dir, "documents"))


@query()
def op11_repeats(spark, sf_dir):
    """Every document without the bytes covered by strings of 400 bytes that also stand elsewhere."""
    out = without_repeats(table(spark, sf_dir, "documents"), 400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
