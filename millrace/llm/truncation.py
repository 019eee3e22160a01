"""Problem 8: texts that were cut off, in SQL.

Texts are split into segments at line breaks and after sentence stops. Every run of three words of a segment is counted, inside (a word
follows) or at the end of a segment; numbers count as one number. A text whose last segment is open (no stop, no line break after
its last word) is a candidate; an ellipsis at the very end, bracketed or not, may be the mark of a field limit and is taken off
before. It is cut
- if its final trigram, or where that is rare its final bigram, is known from inside but almost never ends a segment or a text;
- if its final bigram is not known at all (a word cut in the middle), and no good share of the open texts ends in it;
- if its length in characters or bytes is one at which the texts of its source pile up, most open ones unfinished (a field limit);
  before an ellipsis, even if a sentence ends there;
- if it ends in half a character or half a character entity (a broken transfer), whatever stands before that.
So headings, list items, log lines, table rows, signatures and links are whole where their last words are seen to end things.

Only final n-grams are counted: the tasks hold their trigrams against a bit map (of bounded size) of the candidates' final bigrams, and
shuffle partial counts of what passes. Every count is over all texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from millrace.functions.text import WS
from millrace.operators.lookup import marked
from millrace.session import written

#: A length holds a pile if so many different texts of a source have it, and so many times the mean of the lengths around.
PILE_LEAST, PILE_TIMES, PILE_AROUND = 5, 6, 20

#: An n-gram is known if it is counted so often; it ends nothing if its share of ends is below the limit.
KNOWN, ENDS_SHARE = 4, 0.04

#: Open ends speak for each other (a signature, say) only if they are such a share of all open ends, and more than OPEN_LEAST:
#: the same word cut at the same letter comes again too, but is one of very many.
OPEN_SHARE, OPEN_LEAST = 0.005, 3

#: Ends of segments: a stop with closing quotes or brackets before white space or the end, or a line break. The same back to front.
STOP, CLOSING, LINE = "[.!?。！？]", r"[\x22\x27»”’)\]]", r"[\n\r\u2028\u2029]"
ENDS = rf"{STOP}+{CLOSING}*(?={WS}|$)|{LINE}+"
OPEN_END = rf"^(?!{CLOSING}*{STOP})([^\n\r\u2028\u2029]*?)(?={WS}{CLOSING}*{STOP}|{LINE}|\z)"

#: The beginnings (fixed values) of a character entity; half of one, or half a character, back to front.
ENTITIES = ("a", "am", "amp", "l", "lt", "g", "gt", "q", "qu", "quo", "quot", "n", "nb", "nbs", "nbsp")
HALF = rf"^ *(?:\ufffd|(?:{'|'.join(x[::-1] for x in ENTITIES)}|[0-9]*#)?&)"

#: An ellipsis at the very end, as a field limit may leave it, with brackets and white space around; back to front.
MARK = rf"^{WS}*[\])]?(?:\.{{3,}}|…)[\[(]?{WS}*"

WORDS = r"[\p{L}\p{N}]+"

#: What stands for the end of a segment among its words, and for the missing words before its first.
EDGE = "\u0001"

#: Every text back to front without its mark, and its open last segment; the end is read from behind, so that only it is looked at.
PARTS = f"""
select *, regexp_extract(back, r'{OPEN_END}', 1) as tail
from (select doc_id, source, text, mark <> '' as marked, back0, if(mark = '', back0, substr(back0, char_length(mark) + 1)) as back
      from (select doc_id, source, text, reverse(text) as back0, regexp_extract(reverse(text), r'{MARK}', 0) as mark from $docs where doc_id is not null and text is not null))
"""

#: The last three words of the open last segment of each text (EDGE before its first); c is null where no segment is open.
TAILS = f"""
select doc_id, source, chars, bytes, broken, marked, text_hash, try_element_at(w, -1) as c, coalesce(try_element_at(w, -2), '{EDGE}') as b, coalesce(try_element_at(w, -3), '{EDGE}') as a
from (select doc_id, lower(trim(source)) as source, char_length(text) as chars, octet_length(text) as bytes, xxhash64(text) as text_hash, marked,
             back0 rlike r'{HALF}' or marked and back rlike r'{HALF}' as broken, regexp_extract_all(regexp_replace(lower(reverse(tail)), '[0-9]+', '0'), r'{WORDS}', 0) as w
      from ({PARTS}))
"""

#: Every word with the two before and the one after it; not the last word of an open end, which nothing is known to follow.
TRIGRAMS = f"""
select t.*
from (select regexp_extract_all(regexp_replace(regexp_replace(translate(lower(body), '{EDGE}', ' '), '[0-9]+', '0'), r'{ENDS}', '{EDGE}'), r'{WORDS}|{EDGE}', 0) as w
      from (select substr(text, 1, char_length(text) - char_length(regexp_extract(reverse(text), r'{MARK}', 0))) as body from $docs where doc_id is not null and text is not null))
lateral view inline(arrays_zip(concat(array('{EDGE}', '{EDGE}'), w), concat(array('{EDGE}'), w), w, slice(w, 2, size(w)))) t as a, b, c, d
where c <> '{EDGE}' and d is not null
"""

#: The n-grams of all texts: their hashes, and whether they end a segment.
HITS = f"select xxhash64(if(b = '{EDGE}', b, a), b, c) as h3, xxhash64(b, c) as key, cast(d = '{EDGE}' as int) as ends from ({TRIGRAMS})"

#: Counts of those that pass the bit map, inside and at the ends of segments.
COUNTS = """
select h, count(*) - sum(ends) as inside, sum(ends) as ends
from (select stack(2, h3, ends, key, ends) as (h, ends) from $hits)
group by h
"""

#: What the final n-grams say of each open end; verdict is null for a whole text and where none is open.
JUDGED = f"""
with ended as (select xxhash64(a, b, c) as h3, xxhash64(b, c) as h2, * from $tails),
enough as (select greatest({OPEN_LEAST}, {OPEN_SHARE} * count(distinct text_hash)) as least from ended where c is not null),
last3 as (select h3, if(n > (select least from enough), n - 1, 0) as n from (select h3, count(distinct text_hash) as n from ended group by h3)),
last2 as (select h2, if(n > (select least from enough), n - 1, 0) as n from (select h2, count(distinct text_hash) as n from ended group by h2)),
counted as (
  select e.*, coalesce(c3.inside, 0) as inside3, coalesce(c3.ends, 0) + last3.n as ends3, coalesce(c2.inside, 0) as inside2, coalesce(c2.ends, 0) + last2.n as ends2
  from ended e join last3 using (h3) join last2 using (h2) left join $counts c3 on c3.h = e.h3 left join $counts c2 on c2.h = e.h2)
select doc_id, source, chars, bytes, text_hash, broken, marked, c is not null as open, inside3, ends3, inside2, ends2,
       case when c is null then null
            when inside3 + ends3 >= {KNOWN} then case when ends3 < {ENDS_SHARE} * (inside3 + ends3) then 'unfinished sentence' end
            when inside2 + ends2 >= {KNOWN} then case when ends2 < {ENDS_SHARE} * (inside2 + ends2) then 'unfinished sentence' end
            else 'unfinished word' end as verdict
from counted
"""

#: Lengths at which the distinct texts of a source (all, open or not) pile up, by characters and by bytes, and at which most texts
#: with an open end or an ellipsis are unfinished: field limits. A text without a source is held against those of all.
LIMITS = f"""
with lengths as (
  select source, unit, length, count(distinct text_hash) as n, avg(case when open or marked then if(open and verdict is null, 0, 1) end) as unfinished
  from (select source, text_hash, verdict, open, marked, stack(2, 'chars', chars, 'bytes', bytes) as (unit, length) from $judged)
  group by source, unit, length)
select distinct stack(2, source, unit, length, null, unit, length) as (source, unit, length)
from (select *, sum(n) over (partition by source, unit order by length range between {PILE_AROUND} preceding and {PILE_AROUND} following)
              - sum(n) over (partition by source, unit order by length range between 3 preceding and 3 following) as around from lengths)
where n >= {PILE_LEAST} and n >= {PILE_TIMES} * around / (2 * {PILE_AROUND} - 6) and unfinished >= 0.5
"""

CUT = """
select j.doc_id, inside3, ends3, inside2, ends2, verdict, broken, coalesce(by_chars.length, by_bytes.length) is not null and (open or marked) as limited,
       case when broken then 'broken transfer' when verdict is not null then verdict when coalesce(by_chars.length, by_bytes.length) is not null and (open or marked) then 'field limit' end as evidence
from (select * from $judged where open or marked or broken) j
left join $limits by_chars on by_chars.unit = 'chars' and by_chars.source <=> j.source and by_chars.length = j.chars
left join $limits by_bytes on by_bytes.unit = 'bytes' and by_bytes.source <=> j.source and by_bytes.length = j.bytes
"""


def _run(sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over the given tables, which it names with a dollar sign."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        view = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        sql = sql.replace(f"${name}", view)
    return spark.sql(sql)


def judged_ends(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, inside3, ends3, inside2, ends2, verdict, broken, limited, evidence) of every text with an open end, an ellipsis at its end
    or a broken one; evidence is null for a whole one.

    Null ids and texts and texts with none of these (empty ones too) are left out; a null source is a source of its own. Repeated
    texts count once as ends. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.selectExpr(f"`{doc_id}` as doc_id", f"`{source}` as source", f"`{text}` as text")
    tails = written(_run(TAILS, docs=docs), "tails")
    hits = marked(_run(HITS, docs=docs), tails.where("c is not null").selectExpr("xxhash64(b, c) as key"))
    counts = written(_run(COUNTS, hits=hits), "counts")
    judged = written(_run(JUDGED, tails=tails, counts=counts), "judged")
    return _run(CUT, judged=judged, limits=_run(LIMITS, judged=judged))


def cut_texts(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, evidence) of the texts that were cut off."""
    return judged_ends(docs, **columns).where("evidence is not null").select("doc_id", "evidence")


def cut_rates(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(source, documents, cut, rate): how often each source cuts its texts; spellings of a source are unified."""
    cut = cut_texts(docs, doc_id=doc_id, source=source, text=text).select("doc_id", "evidence")
    rows = docs.selectExpr(f"`{doc_id}` as doc_id", f"lower(trim(`{source}`)) as source").join(cut, "doc_id", "left")
    return rows.groupBy("source").agg({"doc_id": "count", "evidence": "count"}).selectExpr("source", "`count(doc_id)` as documents", "`count(evidence)` as cut", "`count(evidence)` / `count(doc_id)` as rate")
