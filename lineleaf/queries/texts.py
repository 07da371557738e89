"""Text, page and sizing queries on documents, pages, conversations and lineitems."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import document as D
from ..operators import ocr as O
from .catalog import load

LINES_SQL = "(select doc_id, source, generate_subscripts(l, 1) - 1 as pos, unnest(l) as line from (select doc_id, source, string_split(text, chr(10)) as l from documents))"


def lines(s, d):
    return load(s, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def predicate(column, name):
    def query(s, d):
        return lines(s, d).select("doc_id", "pos", column(F.col("line")).alias(name))

    return query


def joined_lines(s, d):
    x = load(s, d, "documents").where("text is not null")
    return x.select("doc_id", T.join_all(F.split("text", "\n")).alias("joined"))


def html_strip(s, d):
    return load(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


def html_to_text(s, d):
    return load(s, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


def html_to_markdown(s, d):
    return load(s, d, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("markdown"))


def script_anomaly(s, d):
    return load(s, d, "documents").select("doc_id", T.has_unexpected_script(F.col("text"), ["en", "fr"]).alias("odd"))


def degenerate_loop(s, d):
    """Texts as answers to a block whose source had as many lines as the number's remainder by 20."""
    return load(s, d, "documents").select("doc_id", O.loops(F.col("text"), F.col("doc_id") % 20).alias("loops"))


def running_heads(s, d):
    x = D.as_boxes(lines(s, d).withColumn("doc", F.struct("source", "doc_id")), "doc").select("doc.source", "doc.doc_id", "pos", "line", "y0", "h")
    return D.running_heads(x, "source", "doc_id", "pos")


def page_geometry(s, d):
    return D.page_geometry(D.as_boxes(lines(s, d)), "doc_id", F.lit(800))


def footnote_region(s, d):
    return D.footnotes(D.as_boxes(lines(s, d)), "doc_id").where("is_note").select("doc_id", "pos")


def heading_score(s, d):
    x = D.heading_scores(D.as_boxes(lines(s, d)), "doc_id", F.lit(800))
    return x.select("doc_id", "pos", F.round("score", 4).alias("score"), "is_heading")


def heading_levels(s, d):
    x = load(s, d, "documents").select("source", "doc_id", F.round(F.col("n_chars") / 2000, 4).alias("ratio"))
    return D.heading_levels(x, "source", "ratio", "doc_id").select("source", "doc_id", "level")


def reading_order(s, d):
    b = load(s, d, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.col("l_orderkey").alias("k"), "l_linenumber", (F.floor("l_extendedprice") % 1000).cast("long").alias("x0"),
        (F.floor("l_extendedprice") % 1000 + F.floor("l_quantity") * 6).cast("long").alias("x1"), F.col("l_partkey").alias("y0"), F.unix_timestamp("l_shipdate").alias("z"),
    ).distinct()
    return D.reading_order(b, "page", F.lit(1000), ["k", "l_linenumber", "z", "x1"]).groupBy("page", "column").agg(F.count("*").alias("n"), F.sum(F.col("place") * F.col("y0")).alias("mark"))


def paragraph_merge(s, d):
    """Turns of a conversation as pages with one paragraph each; every fifth is a quote."""
    c = load(s, d, "conversations")
    kind = F.when(F.col("turn") % 5 == 0, "quote").otherwise("para")
    own = (~T.is_terminated(F.col("text"))).alias("open_end"), T.looks_continuation(F.col("text")).alias("open_start")
    return D.merge_paragraphs(c.select("conv_id", "turn", F.lit(0).alias("no"), kind.alias("kind"), F.lit(0).alias("level"), "text", *own), "conv_id", "turn")


def mark_pages(s, d):
    """Texts cut at marker lines: each line belongs to the marker above it."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = lines(s, d).withColumn("mark", F.col("line").contains("License")).withColumn("part", F.sum(F.col("mark").cast("long")).over(w))
    return x.groupBy("doc_id", "part").agg(F.count("*").alias("n"))


def word_overlap_dice(s, d):
    """Dice of word counts between every benchmark item and its same-numbered document."""
    words = lambda df, k, t: df.select(F.col(k).alias("k"), F.explode(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0))).alias("w")).groupBy("k", "w").agg(F.count("*").alias("n"))
    a, b = words(load(s, d, "documents"), "doc_id", "text"), words(load(s, d, "benchmark"), "item_id", "text")
    shared = a.alias("a").join(b.alias("b"), ["k", "w"]).groupBy("k").agg(F.sum(F.least("a.n", "b.n")).alias("c"))
    size = lambda x, name: x.groupBy("k").agg(F.sum("n").alias(name))
    return size(b, "m").join(size(a, "n"), "k").join(shared, "k", "left").select("k", F.round(2 * F.coalesce("c", F.lit(0)) / (F.col("m") + F.col("n")), 6).alias("dice"))


def mm_to_px(s, d):
    return load(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(G.mm_to_px(F.col("l_quantity"), F.lit(300))).alias("px"))


def bucket_pick(s, d):
    x = load(s, d, "part").select("p_partkey", G.pick_bucket(F.col("p_size"), F.floor(F.col("p_retailprice"))).alias("bucket"))
    return x.groupBy("bucket").agg(F.count("*").alias("n"))


def backoff_schedule(s, d):
    return s.range(12).select("id", G.backoff_minutes(F.col("id")).alias("minutes"))


def time_ago_bucket(s, d):
    now = F.lit("2024-02-15 00:00:00").cast("timestamp")
    return load(s, d, "events").select(T.time_ago(F.col("ts"), now).alias("ago")).groupBy("ago").agg(F.count("*").alias("n"))


def pair_score(s, d):
    """Every two lines of an order, the smaller number first."""
    b = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.floor("l_extendedprice") % 800).alias("x0"), (F.floor("l_extendedprice") % 800 + F.floor("l_quantity") + 1).alias("x1"), (F.col("l_partkey") % 50).alias("y0"), (F.col("l_partkey") % 50 + 20).alias("y1"))
    b = b.groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("x0", "x1", "y0", "y1")))
    a, c = b.alias("a"), b.withColumnRenamed("l_linenumber", "other_line").alias("c")
    box = lambda n: {k: F.col(f"{n}.{k}") for k in ("x0", "x1", "y0", "y1")}
    return a.join(c, "l_orderkey").where("l_linenumber < other_line").select("l_orderkey", "l_linenumber", "other_line", F.floor(G.pair_score(box("a"), box("c"), F.lit(1000), F.lit(100)) * 10_000 + 1e-6).alias("score"))


def target_sizes(s, d):
    x = load(s, d, "part").select("p_partkey", G.target_size(F.col("p_size") * 40, F.col("p_size") * 60, F.when(F.col("p_partkey") % 3 > 0, F.col("p_size") * 10), 200.0).alias("z"))
    return x.select("p_partkey", F.col("z")[0].alias("w"), F.col("z")[1].alias("h"))


def margin_sides(s, d):
    v = F.when(F.col("p_partkey") % 3 == 0, "5").when(F.col("p_partkey") % 3 == 1, "4 6").otherwise("1,2,3,4")
    x = load(s, d, "part").select("p_partkey", G.margin_sides(v).alias("m"))
    return x.select("p_partkey", *(F.col("m")[i].alias(n) for i, n in enumerate(("l", "r", "t", "b"))))


def op_list(s, d):
    x = load(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return x.select("o_custkey", T.fmt_list(F.transform("k", lambda v: v.cast("string"))).alias("said"))


def fmt_ms(s, d):
    return load(s, d, "events").select("event_id", T.fmt_ms(F.col("event_id") * 17).alias("took"))


def knn_ratio_test(s, d):
    """Nearest and second nearest vector of another label's number; kept where the first is clearly nearer."""
    return D.ratio_matches(load(s, d, "embeddings"), "vec_id", "embedding", "label", 0.97)


BOXED = f"""(select doc_id, source, pos, length(line) as len, line, pos * 40 + (pos // 7) * 25 as y0, 20 + length(line) % 9 as h, (pos % 5) * 10 as x0,
  (pos % 5) * 10 + 8 * least(length(line), 90) as x1 from {LINES_SQL} where trim(line) <> '')"""
GAPS = f"(select *, y0 - lag(y0 + h) over (partition by doc_id order by pos) as gap_above, lead(y0) over (partition by doc_id order by pos) - (y0 + h) as gap_below from {BOXED})"
GEO = f"(select doc_id, median_h, p10, p90, coalesce(g, 0.4 * median_h) as median_gap, page_h, n from (select doc_id, quantile_cont(h, 0.5) as median_h, quantile_cont(x0, 0.1) as p10, quantile_cont(x1, 0.9) as p90, quantile_cont(gap_above, 0.5) filter (where gap_above > 0) as g, greatest(1, max(y0 + h)) as page_h, count(*) as n from {GAPS} group by 1))"
#: The drawn pages are 800 wide. Edges of a page count as a gap like the median one.
MEASURED = f"(select g.doc_id, source, pos, line, trim(line, ' ') as bare, y0, h, x0, x1, coalesce(gap_above, median_gap) as gap_above, coalesce(gap_below, median_gap) as gap_below, h / median_h as ratio, median_gap, p10, p90, page_h, n, row_number() over (partition by g.doc_id order by pos) as k from {GAPS} g join {GEO} using (doc_id))"
TERMINATED = "(regexp_replace({0}, '[\\s\"'')\\]»”’]*$', '') = '' or right(regexp_replace({0}, '[\\s\"'')\\]»”’]*$', ''), 1) in ('.', '!', '?', '…', ':'))"
PAGE_NUMBER = "(regexp_matches({0}, '^[\\p{{Nd}} IVXLCDMivxlcdm.—\\-–()\\[\\]]{{1,12}}$') and regexp_matches({0}, '[\\p{{L}}\\p{{Nd}}]'))"
SIGNATURE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '\\d+', '', 'g'), '[^\\p{L}\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
STRIPPED = "regexp_replace(line, '^\\s+|\\s+$', '', 'g')"

ORACLE_SQL = {
    "line_terminated": f"select doc_id, pos, b = '' or right(b, 1) in ('.', '!', '?', '…', ':') as terminated from (select *, regexp_replace(line, '[\\s\"'')\\]»”’]*$', '') as b from {LINES_SQL})",
    "line_hyphen": f"select doc_id, pos, regexp_matches(line, '\\p{{L}}[-¬]\\s*$') as hyphen from {LINES_SQL}",
    "line_continuation": f"select doc_id, pos, regexp_matches(line, '^\\s*(\\p{{Ll}}|[),;»”’])') as continues from {LINES_SQL}",
    "line_bold": f"select doc_id, pos, length(b) <= 60 and not regexp_matches(b, '\\p{{Ll}}') and len(regexp_extract_all(b, '\\S+')) >= 2 and len(regexp_extract_all(b, '\\p{{Lu}}')) >= 2 as bold from (select *, trim(line, ' ') as b from {LINES_SQL})",
    "line_page_number": f"select doc_id, pos, {PAGE_NUMBER.format(STRIPPED)} as page_number from {LINES_SQL}",
    "line_list_item": f"select doc_id, pos, nullif(regexp_extract(line, '^\\s*(?:[•·▪◦*]|\\d{{1,3}}[.)]|[A-Za-z]\\)|[IVXLC]{{1,6}}\\.)\\s+(.*)$', 1), '') as item from {LINES_SQL}",
    "line_signature": f"select doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '\\d+', '', 'g'), '[^\\p{{L}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as signature from {LINES_SQL}",
    "html_strip": "select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as text from pages",
    "script_anomaly": "select doc_id, len(regexp_extract_all(text, '[\\p{Greek}\\p{Cyrillic}\\p{Hebrew}\\p{Arabic}\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Hangul}]')) >= 2 as odd from documents",
    "degenerate_loop": f"select doc_id, coalesce(n >= 8 and (n > greatest(8, doc_id % 20 * 3) or 2 * u < n), false) as loops from documents left join (select doc_id, count(*) as n, count(distinct regexp_replace(line, '^\\s*(?:\\d+|[a-z])[.)]\\s*', '')) as u from {LINES_SQL} where trim(line, ' ') <> '' group by 1) using (doc_id)",
    "running_heads": f"""with b as (select source, doc_id, pos, {SIGNATURE} as sig, {PAGE_NUMBER.format(STRIPPED)} as num, y0, row_number() over w as k, count(*) over (partition by doc_id) as n, greatest(1, max(y0 + h) over (partition by doc_id)) as page_h from {BOXED} window w as (partition by doc_id order by pos)),
      c as (select source, sig, count(*) filter (where k <= 2) as a, count(*) filter (where k > n - 2) as z from b where sig <> '' and source in (select source from b group by 1 having count(distinct doc_id) >= 3) group by all),
      e as (select b.*, k <= 2 or y0 < 0.1 * page_h as top, k > n - 2 or y0 > 0.9 * page_h as low, coalesce(a, 0) >= 3 as in_top, coalesce(z, 0) >= 3 as in_low from b left join c using (source, sig))
      select source, doc_id, pos, sig, num or row_number() over (partition by source, sig, num order by doc_id, pos) > 1 as dropped from e where num and (top or low) or top and in_top or low and in_low""",
    "page_geometry": f"select doc_id, round(median_h, 4) as median_h, round(p10, 4) as left_edge, round(p90, 4) as right_edge, round(median_gap, 4) as median_gap, round(1.6 * median_gap, 4) as para_gap, round(greatest(median_h, 14.4), 4) as indent, 96.0::double as short_by from {GEO}",
    "footnote_region": f"""with low as (select doc_id, k, gap_above, row_number() over w as rk, lead(gap_above) over w as second from {MEASURED} where k > 1 and y0 > 0.58 * page_h window w as (partition by doc_id order by gap_above desc, k desc)),
      m as (select m.*, low.k as cut from {MEASURED} m left join low on low.doc_id = m.doc_id and rk = 1 and low.gap_above >= 3 * median_gap and low.gap_above >= 1.8 * greatest(coalesce(second, 0), 1.6 * median_gap) and n - low.k >= 1)
      select doc_id, pos from m where coalesce(k >= cut, false) or ratio < 0.8 and y0 > 0.6 * page_h""",
    "heading_score": f"""with f as (select *, length(bare) as len, regexp_matches(bare, '(?i)^((chapitre|chapter|section|partie|livre|titre|article|prologue|introduction|conclusion|annexe|appendice)([^\\p{{L}}\\p{{N}}_]|$)|§[\\p{{L}}\\p{{N}}_])') as kw,
        regexp_matches(bare, '^(\\d{{1,3}}|[IVXLC]{{1,6}}|[A-Za-z])[.)]\\s*[—–\\-]\\s*\\S') as sec, regexp_matches(bare, '^[IVXLC]{{1,6}}[.—\\-]?\\s') as roman, not {TERMINATED.format('bare')} as open_end,
        len(regexp_extract_all(bare, '\\p{{L}}')) >= 2 and not regexp_matches(bare, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]') as caps, x0 - p10 > 48 and abs((x0 - p10) - (p90 - x1)) < 80 as centred from {MEASURED}),
      s as (select *, case when ratio >= 1.6 then 2.0 when ratio >= 1.3 then 1.2 when ratio >= 1.15 then 0.6 else 0 end + case when gap_above > 1.4 * median_gap then 0.6 else 0 end + case when gap_below > 1.4 * median_gap then 0.6 else 0 end
        + case when centred then 0.8 else 0 end + case when len <= 40 then 0.4 else 0 end + case when caps then 0.8 else 0 end + case when kw then 1.0 else 0 end + case when roman then 0.4 else 0 end + case when sec then 1.0 else 0 end + case when open_end then 0.2 else 0 end as score from f)
      select doc_id, pos, cast(round(score, 4) as double) as score, len <= 80 and (kw or sec and caps or ratio >= 0.9 and score >= 1.8) as is_heading from s""",
    "heading_levels": """with a as (select source, doc_id, round(n_chars / 2000, 4) as ratio from documents), p as (select * from a where ratio > 0),
      b as (select *, row_number() over w as no, ratio - lag(ratio) over w as step from p window w as (partition by source order by ratio, doc_id)),
      r as (select *, row_number() over (partition by source order by step desc nulls last, no) <= 2 and step is not null as cut from b),
      c as (select *, sum(cut::int) over (partition by source order by no) as g from r), t as (select source, g, avg(ratio) as c from c group by all),
      k as (select *, row_number() over (partition by source order by c desc, g desc) as k from t),
      l as (select source, c, k, least(3, max(greatest(k, case when c >= 1.7 then 1 when c >= 1.35 then 2 else 3 end)) over (partition by source order by k)) as level from k)
      select source, doc_id, cast(coalesce((select level from l where l.source = a.source order by abs(c - a.ratio), k limit 1), 2) as bigint) as level from a""",
    "paragraph_merge": """with c as (select conv_id, turn, text, case when turn % 5 = 0 then 'quote' else 'para' end as kind, regexp_replace(text, '[\\s\"'')\\]»”’]*$', '') as b, regexp_matches(text, '^\\s*(\\p{Ll}|[),;»”’])') as goes_on from conversations),
      e as (select *, b = '' or right(b, 1) in ('.', '!', '?', '…', ':') as ends from c),
      n as (select *, not coalesce(not lag(ends) over w and goes_on and lag(kind) over w = kind, false) as new from e window w as (partition by conv_id order by turn)),
      p as (select *, sum(new::int) over (partition by conv_id order by turn) as block from n),
      q as (select *, lead(text) over w as after, case when row_number() over w = 1 then text else ltrim(text, ' ') end as own from p window w as (partition by conv_id, block order by turn))
      select conv_id, cast(block as bigint) as block, min_by(kind, turn) as kind, 0 as level, string_agg(case when after is null then own when regexp_matches(rtrim(own, ' '), '\\p{L}[-¬]\\s*$') and regexp_matches(ltrim(after, ' '), '^\\p{Ll}') then regexp_replace(rtrim(own, ' '), '[-¬]$', '') else rtrim(own, ' ') || ' ' end, '' order by turn) as text from q group by 1, 2""",
    "mark_pages": f"select doc_id, cast(part as bigint) as part, count(*) as n from (select doc_id, sum(contains(line, 'License')::int) over (partition by doc_id order by pos) as part from {LINES_SQL}) group by all",
    "word_overlap_dice": "with a as (select k, w, count(*) as n from (select doc_id as k, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents) group by all), b as (select k, w, count(*) as n from (select item_id as k, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from benchmark) group by all), c as (select k, sum(least(a.n, b.n)) as c from a join b using (k, w) group by 1) select k, round(2 * coalesce(c, 0) / (m + n), 6) as dice from (select k, sum(n) as m from b group by 1) join (select k, sum(n) as n from a group by 1) using (k) left join c using (k)",
    "mm_to_px": "select l_suppkey, cast(sum(round_even(l_quantity * 300 / 25.4, 0)) as bigint) as px from lineitem group by 1",
    "bucket_pick": "select case when p_size <= 30 and floor(p_retailprice) <= 1300 then 0 when p_size <= 40 and floor(p_retailprice) <= 1700 then 1 when p_size <= 55 and floor(p_retailprice) <= 2300 then 2 when p_size <= 75 and floor(p_retailprice) <= 3100 then 3 when p_size <= 95 and floor(p_retailprice) <= 4200 then 4 when p_size <= 120 and floor(p_retailprice) <= 6000 then 5 end as bucket, count(*) as n from part group by 1",
    "backoff_schedule": "select i as id, case when i < 10 then cast(least(512, pow(2, i)) as int) end as minutes from range(12) t(i)",
    "time_ago_bucket": "with a as (select cast(epoch(timestamp '2024-02-15') - floor(epoch(ts)) as bigint) as s from events), b as (select case when s < 45 then 'just now' when s < 3600 then greatest(1, s // 60) || ' minute' when s < 86400 then s // 3600 || ' hour' when s < 2592000 then s // 86400 || ' day' when s < 31536000 then s // 2592000 || ' month' else s // 31536000 || ' year' end as t from a) select case when t = 'just now' then t when starts_with(t, '1 ') then t || ' ago' else t || 's ago' end as ago, count(*) as n from b group by 1",
    "margin_sides": "select p_partkey, cast(case p_partkey % 3 when 0 then 5 when 1 then 6 else 1 end as double) as l, cast(case p_partkey % 3 when 0 then 5 when 1 then 6 else 2 end as double) as r, cast(case p_partkey % 3 when 0 then 5 when 1 then 4 else 3 end as double) as t, cast(case p_partkey % 3 when 0 then 5 when 1 then 4 else 4 end as double) as b from part",
    "op_list": "select o_custkey, array_to_string(k[1:6], ',') || case when len(k) > 6 then ',+' || (len(k) - 6) || ' more' else '' end as said from (select o_custkey, list_sort(list(o_orderkey)) as k from orders group by 1)",
    "target_sizes": "with a as (select p_partkey, p_size * 40 as w, p_size * 60 as h, case when p_partkey % 3 > 0 then p_size * 10 end as dpi from part), b as (select *, case when dpi > 0 then case when dpi <= 220.00000000000003 then 1.0 else 200.0 / dpi end else least(1.0, 2400.0 / greatest(w, h)) end as sc from a) select p_partkey, cast(case when sc < 1 then greatest(64, floor(w * cast(sc as double))) else w end as int) as w, cast(case when sc < 1 then greatest(64, floor(h * cast(sc as double))) else h end as int) as h from b",
    "reading_order": """with b as (select distinct l_suppkey as page, l_orderkey as k, l_linenumber, cast(floor(l_extendedprice) % 1000 as bigint) as x0, cast(floor(l_extendedprice) % 1000 + floor(l_quantity) * 6 as bigint) as x1, l_partkey as y0, cast(epoch(l_shipdate) as bigint) as z from lineitem),
      c as (select page, count(*) as n, """ + ", ".join(f"count(*) filter (where (x0 + x1) / 2.0 < {x}) as l{x}, count(*) filter (where (x0 + x1) / 2.0 >= {x}) as r{x}, count(*) filter (where x0 < {x} and x1 > {x}) as a{x}" for x in (500, 450, 550)) + """ from b group by 1),
      p as (select page, case when n < 6 then null """ + " ".join(f"when l{x} >= 3 and r{x} >= 3 and a{x} <= greatest(1, 0.08 * n) then {x}" for x in (500, 450, 550)) + """ end as cut from c),
      o as (select b.*, case when cut is null or (x0 + x1) / 2.0 < cut then 0 else 1 end as "column" from b join p using (page)),
      r as (select *, row_number() over (partition by page order by "column", y0, x0, k, l_linenumber, z, x1) as place from o)
      select page, "column", count(*) as n, cast(sum(place * y0) as bigint) as mark from r group by all""",
    "pair_score": """with l as (select l_orderkey, l_linenumber, min(cast(floor(l_extendedprice) as bigint) % 800) as x0, min(cast(floor(l_extendedprice) as bigint) % 800 + cast(floor(l_quantity) as bigint) + 1) as x1, min(l_partkey % 50) as y0, min(l_partkey % 50 + 20) as y1 from lineitem group by all),
      j as (select a.l_orderkey, a.l_linenumber, c.l_linenumber as other_line, a.x1 - a.x0 as aw, c.x1 - c.x0 as bw, a.y1 - a.y0 as ah, c.y1 - c.y0 as bh,
        greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / (greatest(a.y1, c.y1) - least(a.y0, c.y0))::double as yo, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) / (greatest(a.x1, c.x1) - least(a.x0, c.x0))::double as xo,
        case when a.x1 < c.x0 then c.x0 - a.x1 when c.x1 < a.x0 then a.x0 - c.x1 else 0 end as gx, case when a.y1 < c.y0 then c.y0 - a.y1 when c.y1 < a.y0 then a.y0 - c.y1 else 0 end as gy
        from l a join l c on a.l_orderkey = c.l_orderkey and a.l_linenumber < c.l_linenumber),
      s as (select *, yo * (0.4::double * greatest(0.0::double, 1 - gx / 1000 / 0.15::double) + 0.6::double * (1 - least(aw, bw) / greatest(aw, bw))) as beside,
        xo * (0.4::double * greatest(0.0::double, 1 - gy / 100 / 0.15::double) + 0.6::double * (1 - least(ah, bh) / greatest(ah, bh))) as stacked from j)
      select l_orderkey, l_linenumber, other_line, cast(floor(greatest(beside, stacked) * 10000 + 1e-6) as bigint) as score from s""",
    "knn_ratio_test": "with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings where vec_id % 100 = 0), a as (select vec_id, label, cast(embedding as double[]) as v from embeddings), d as (select e.vec_id, a.vec_id as other, list_distance(e.v, a.v) as dist from e join a on a.label = e.label and a.vec_id <> e.vec_id), r as (select *, row_number() over (partition by vec_id order by dist, other) as k, lead(dist) over (partition by vec_id order by dist, other) as second from d) select vec_id, other, round(dist, 6) as dist from r where k = 1 and dist < 0.97 * second",
}
QUERIES = {
    "line_terminated": predicate(T.is_terminated, "terminated"),
    "line_hyphen": predicate(T.ends_hyphen, "hyphen"),
    "line_continuation": predicate(T.looks_continuation, "continues"),
    "line_bold": predicate(T.looks_bold, "bold"),
    "line_heading": predicate(T.looks_heading, "heading"),
    "line_page_number": predicate(T.is_page_number, "page_number"),
    "line_list_item": predicate(T.list_marker, "item"),
    "line_signature": predicate(T.norm_running, "signature"),
    "joined_lines": joined_lines,
    "html_strip": html_strip,
    "html_to_text": html_to_text,
    "html_to_markdown": html_to_markdown,
    "script_anomaly": script_anomaly,
    "degenerate_loop": degenerate_loop,
    "running_heads": running_heads,
    "page_geometry": page_geometry,
    "footnote_region": footnote_region,
    "heading_score": heading_score,
    "heading_levels": heading_levels,
    "reading_order": reading_order,
    "paragraph_merge": paragraph_merge,
    "mark_pages": mark_pages,
    "word_overlap_dice": word_overlap_dice,
    "mm_to_px": mm_to_px,
    "bucket_pick": bucket_pick,
    "backoff_schedule": backoff_schedule,
    "time_ago_bucket": time_ago_bucket,
    "pair_score": pair_score,
    "target_sizes": target_sizes,
    "margin_sides": margin_sides,
    "op_list": op_list,
    "fmt_ms": fmt_ms,
    "knn_ratio_test": knn_ratio_test,
}
