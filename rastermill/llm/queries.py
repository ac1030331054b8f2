"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, embeddings, interaction, langid, lines, packing, quality, simhash, template, urls, warc, wordpiece

#: (host, path, verdict) of the rules that op8 applies.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of_pages(_table(spark, sf_dir, "pages")), keep=("page_id",))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, longs=1, limit=4)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract_main_text(_table(spark, sf_dir, "pages"))


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(_table(spark, sf_dir, "documents"))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality, op3_warc_derivatives, op4_packing, op5_simhash, op6_token_counts, op7_main_text, op8_url_verdicts, op9_embedding_neardup, op10_line_dedup, op11_language, op12_interaction, op13_divergence)}


#: What the SQL of op3 can follow: closed markup and the references that the given pages hold. The operator does more.
_SQL_MARKUP = [
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script[^>]*>.*?</script>", " "),
    (r"(?is)<style[^>]*>.*?</style>", " "),
    (r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(\s[^>]*)?/?>", "\n"),
    (r"(?s)<[^>]*>", ""),
]
_SQL_REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _warc_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def plain(x: str) -> str:
        for pattern, to in _SQL_MARKUP:
            x = f"regexp_replace({x}, {quoted(pattern)}, " + ("chr(10)" if to == "\n" else quoted(to)) + ", 'g')"
        for name, to in _SQL_REFERENCES:
            x = f"replace({x}, {quoted(name)}, {quoted(to)})"
        x = rf"regexp_replace(regexp_replace({x}, '[ \t\r\f\x0b]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
        return f"trim({x}, ' ' || chr(10))"

    def urn(kind: str, *parts: str) -> str:
        h = f"md5('{kind}' || '|' || " + " || '|' || ".join(f"coalesce(cast({p} as varchar), '')" for p in parts) + ")"
        cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substring({h}, {s}, {n})" for s, n in cuts) + " || '>'"

    return f"""
with r as (
  select page_id, {urn("response", "page_id", "url")} as response_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload,
         'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) as header
  from pages
), k as (
  select page_id, 'metadata' as warc_type, {urn("metadata", "response_id")} as record_id, response_id as refers_to, target_uri, 'application/warc-fields' as content_type,
         'sourceDigest: sha256:' || sha256(payload) || chr(13) || chr(10) || 'sourceBlockDigest: sha256:' || sha256(header || chr(13) || chr(10) || chr(13) || chr(10) || payload) || chr(13) || chr(10)
         || 'sourceLength: ' || strlen(payload) || chr(13) || chr(10) || 'http-' || replace(header, chr(13) || chr(10), chr(13) || chr(10) || 'http-') || chr(13) || chr(10) as block, payload
  from r
  union all
  select page_id, 'conversion', {urn("conversion", "response_id")}, response_id, target_uri, 'text/plain', {plain("payload")}, payload from r
)
select page_id, warc_type, record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' as warc_date, content_type, block, strlen(block) as content_length,
       'sha256:' || sha256(block) as block_digest, 'sha256:' || sha256(payload) as source_digest
from k
"""


def _urls_sql() -> str:
    """Rules, then the closure over links: absolute, protocol-relative, from the root, and from the page's folder.

    What the operator alone follows: references but &amp;, base elements, dot segments, links in comments and scripts.
    """
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    case = {w: "case " + " ".join(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '{h + p if w == 'rule' else v}'" for h, p, v in ordered) + " end" for w in ("rule", "verdict")}
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '://([^/?#]*)', 1), ''), '{lines.UPPER}', '{lines.LOWER}')"
    path = lambda u: f"coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
    rest = lambda u: f"regexp_extract({u}, '://[^/?#]*([^#]*)', 1)"
    address = lambda u: f"{host(u)} || case when starts_with({rest(u)}, '/') then {rest(u)} else '/' || {rest(u)} end"
    found = lambda element, attribute: f"list_transform(regexp_extract_all(html, '{element}'), lambda e: regexp_extract(e, '{attribute}', 1))"
    quote = "[\"\\x27]?"
    canonical = found(rf"(?is)<link\s[^>]*\brel\s*=\s*{quote}canonical\b[^>]*>", rf"(?is)\bhref\s*=\s*{quote}\s*([^\"\x27\s>]+)")
    refresh = found(rf"(?is)<meta\s[^>]*\bhttp-equiv\s*=\s*{quote}refresh\b[^>]*>", rf"(?is)\burl\s*=\s*{quote}\s*([^\"\x27\s>;]+)")
    return f"""
with recursive p as (select page_id, url, {host("url")} as host, {path("url")} as path, case when contains(url, '://') then {address("url")} end as spot from pages),
t as (select url, replace(unnest(list_concat({canonical}, {refresh})), '&amp;', '&') as t from pages where contains(url, '://')),
u as (select url, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') then t when starts_with(t, '//') then regexp_extract(url, '^([^:]*:)', 1) || t when starts_with(t, '/') then regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || t
 when starts_with(t, '?') then regexp_extract(url, '^([^:]*://[^?#]*)', 1) || t when starts_with(t, '#') then url else regexp_extract(url, '^([^:]*://[^/?#]*)', 1) || coalesce(nullif(regexp_extract({path("url")}, '^(.*/)', 1), ''), '/') || t end as u from t where t <> ''),
e as (select distinct {address("url")} as a, {address("u")} as b from u where contains(u, '://')), l as (select a, b from e union select b, a from e),
reach as (select a as a, a as b from l union select reach.a, l.b from reach join l on reach.b = l.a),
n as (select distinct a as spot, regexp_extract(a, '^([^/]*)', 1) as host, regexp_extract(a, '^[^/]*([^?]*)', 1) as path from l),
v as (select spot, {case["verdict"]} as v from n), c as (select reach.a as spot, min(v.v) as v from reach join v on reach.b = v.spot group by reach.a)
select page_id, host, path, {case["rule"]} as rule, coalesce({case["verdict"]}, c.v, 'allow') as verdict from p left join c on p.spot = c.spot
"""


_VECTORS_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
), n as (
  select *, sqrt(list_dot_product(e, e)) as norm from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0
), links as (
  select a.vec_id as a, b.vec_id as b from n a join n b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) >= 0.98 * a.norm * b.norm
), reach as (
  select vec_id as a, vec_id as b from v
  union
  select reach.a, links.b from reach join links on reach.b = links.a
), c as (select a, min(b) as component_id from reach group by a), d as (select a, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from v join c on v.vec_id = c.a left join d on v.vec_id = d.a
"""

_LINES_SQL = f"""
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{lines.UPPER}', '{lines.LOWER}') as key from l
), c as (
  select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), m as (
  select k.doc_id, k.line, k.pos, c.keeper is not null and k.doc_id <> c.keeper as lost from k left join c on k.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256 from m group by doc_id
"""

#: Every order played through, step by step, from the documents' failures: no coalition, no potential.
_INTERACTION_SQL = f"""
with recursive d as (
  select row_number() over () as rid, doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
), w as (
  select *, list_filter(string_split_regex(text, '[ \\t-\\r]+'), lambda x: x <> '') as words from d
), first as (select text, min(doc_id) as lead from d group by text), l as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), f as (
  select rid, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (case when len(words) < 200 then 'A' else '' end) || (case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end)
    || (case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 'C' else '' end)
    || (case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end) || (case when w.doc_id > lead then 'E' else '' end) as fails
  from w join first using (text) left join l on w.doc_id = l.doc_id
), c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails), o as (
  select '' as filter_order union all select filter_order || x from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) where not contains(filter_order, x)
), s as (
  select filter_order, step, filter_order[step] as own, filter_order[1:step - 1] as before from o, (select unnest(range(1, 6)) as step) where length(filter_order) = 5
), r as (
  select part, filter_order, step, own,
    sum(case when translate(fails, before || own, '') = fails then n else 0 end) as kept,
    sum(case when contains(fails, own) and translate(fails, before, '') = fails then n else 0 end) as removed,
    sum(case when contains(fails, own) and translate(fails, before, '') <> fails then n else 0 end) as redundant,
    sum(case when fails = own then n else 0 end) as unique_fails,
    sum(case when contains(fails, own) and translate(fails, before, '') = fails then good else 0 end) as good_lost,
    sum(case when contains(fails, own) and translate(fails, before, '') = fails then toxic else 0 end) as toxic_lost
  from c, s group by part, filter_order, step, own
)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
from r
"""

_DIVERGENCE_SQL = f"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), '{lines.UPPER}', '{lines.LOWER}') as text from documents
), w as (
  select lang, source, rid, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d
), k as (select lang, term from w group by lang, term having count(distinct rid) >= 30), g as (select distinct lang, source from d),
sizes as (select lang, (select count(*) from k where k.lang = l.lang) as v from (select distinct lang from g) l),
c as (select lang, source, term, count(*) as n from w join k using (lang, term) group by lang, source, term),
grid as (select lang, source, term, coalesce(n, 0)::hugeint as n from g join k using (lang) left join c using (lang, source, term)),
p as (select lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from grid join sizes using (lang)),
lt as (select lang, term, sum(n)::hugeint as n from c group by lang, term),
q as (select lang, term, 1 + (1000000000 * (n + 5)) // ((sum(n) over (partition by lang))::hugeint + 5 * v) as q from lt join sizes using (lang)),
near as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join near n on n.lang = a.lang and n.source = a.source and n.item = b.source),
words as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pairs union all select * from words))
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 50
"""

ORACLES = {"op3_warc_derivatives": _warc_sql(), "op8_url_verdicts": _urls_sql(), "op9_embedding_neardup": _VECTORS_SQL, "op10_line_dedup": _LINES_SQL, "op12_interaction": _INTERACTION_SQL, "op13_divergence": _DIVERGENCE_SQL}
