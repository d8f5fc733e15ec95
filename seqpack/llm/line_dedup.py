"""Operator 1, line dedup in DataFrame functions alone.

A text is split into lines. A rolling hash over the hashes of neighbouring lines cuts between them where it is 0 modulo CUT, so
cuts depend on content and survive shifts; a line of WORDS words or more is cut off on both sides, as a passage of its own.
Chunks of two lines or more, or of WORDS words, are sought in the whole table. Cuts near the ends of a repeated passage depend on
the lines around it, so what lies between the outer cuts would be all that goes. Therefore each two neighbouring lines (lines
without a word passed over) are sought as the smallest chunk too, and pairs that repeat are joined to the longest run: a run of
WORDS words or more goes whole.

Digests are counted first, and only chunks and pairs whose digest repeats are brought together with their bytes. Of those equal in
bytes the first in the order (doc_id, nulls last; digest of the text; position) stays, the others are removed: chunks as they are,
pairs where they form such a run. Other lines are never touched. Joins shuffle at every size, but for digests that stand for more
than one in HOT of all rows: there are HOT of them at most, and these are broadcast.

Defined results: a null text stays null and an empty one empty. Rows equal in doc_id and text count as one document and get the
same result. Lines of white space alone are removed only within a chunk or run. Very long texts are one row of each step, as in the
input; work is in proportion to their lines. Extra columns pass through, and the count gets another name where it is taken. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqpack.llm import common
from seqpack.llm.common import cut

CUT, WORDS, HOT = 4, 50, 4096
_WORD = r"[^\\x20\\x09-\\x0D]+"

#: Chunks (kind 0) and pairs (kind 1) of a text, each from line a to line b, with a digest; pairs with their number j and the words of
#: either line. Nested lambdas over one-element arrays name what is computed once.
_UNITS = r"""
transform(array(split(text, '\n', -1)), lines ->
  transform(array(struct(transform(lines, x -> md5(x)) as h, transform(lines, x -> regexp_count(x, '{word}')) as w)), a ->
    transform(array(struct(
      filter(sequence(0, size(lines) - 1), i -> i = size(lines) - 1 or a.w[i] >= {words} or a.w[i + 1] >= {words} or conv(substr(md5(concat(a.h[i], a.h[i + 1])), 1, 2), 16, 10) % {cut} = 0) as ends,
      filter(sequence(0, size(lines) - 1), i -> a.w[i] > 0) as wordy)), p ->
      concat(
        transform(
          filter(
            transform(p.ends, (e, k) -> struct(if(k = 0, 0, p.ends[k - 1] + 1) as a, e as b)),
            c -> (c.b > c.a or a.w[c.a] >= {words}) and exists(slice(a.w, c.a + 1, c.b - c.a + 1), n -> n > 0)),
          c -> struct(0 as kind, c.a as a, c.b as b, 0 as j, 0 as w1, 0 as w2, xxhash64(array_join(slice(lines, c.a + 1, c.b - c.a + 1), '\n')) as digest)),
        if(size(p.wordy) < 2, array(), transform(
          sequence(0, size(p.wordy) - 2),
          j -> struct(1 as kind, p.wordy[j] as a, p.wordy[j + 1] as b, j as j, a.w[p.wordy[j]] as w1, a.w[p.wordy[j + 1]] as w2, xxhash64('pair', lines[p.wordy[j]], lines[p.wordy[j + 1]]) as digest))))
    )[0])[0])[0]
"""
#: The same with their bytes, for those listed in `at`.
_BYTES = r"""
transform(array(split(text, '\n', -1)), lines ->
  transform(at, u -> struct({own}, if(u.kind = 0, array_join(slice(lines, u.a + 1, u.b - u.a + 1), '\n'), concat(lines[u.a], '\n', lines[u.b])) as bytes)))[0]
"""
_UNIT = ("kind", "a", "b", "j", "w1", "w2", "digest")


def _place() -> Column:
    return F.struct(F.col("id").isNull().alias("last"), "id", "key", "a", "b")


def _suspects(each: DataFrame) -> DataFrame:
    """The rows of each whose digest repeats."""
    counted = cut(each.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(counted.where(F.col("n") > F.lit(each.count() // HOT)).select("digest"))
    rest = counted.join(hot, "digest", "left_anti").select("digest")
    return each.join(hot, "digest").unionByName(each.join(hot, "digest", "left_anti").join(rest.hint("merge"), "digest"))


def _repeated(docs: DataFrame, cut_at: int, words: int) -> DataFrame:
    """(id, key, gone): the stretches of lines that are to be removed from each text of docs (id, key, text)."""
    units = F.expr(_UNITS.format(cut=cut_at, words=words, word=_WORD))
    each = cut(docs.select("id", "key", F.explode(units).alias("u")).select("id", "key", "u.*"))
    listed = _suspects(each).groupBy("id", "key").agg(F.collect_set(F.struct(*_UNIT)).alias("at"))
    listed = listed.select(F.col("id").alias("its"), F.col("key").alias("own"), "at")
    found = docs.join(listed.hint("merge"), F.col("id").eqNullSafe(F.col("its")) & (F.col("key") == F.col("own")))
    found = cut(found.select("id", "key", F.explode(F.expr(_BYTES.format(own=", ".join(f"u.{c} as {c}" for c in _UNIT)))).alias("u")).select("id", "key", "u.*"))
    firsts = found.groupBy("kind", "digest", "bytes").agg(F.min(_place()).alias("m")).select(F.col("kind").alias("k"), F.col("m.id").alias("i"), F.col("m.key").alias("o"), F.col("m.a").alias("f"), F.col("m.b").alias("t"))
    is_first = F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("o")) & (F.col("kind") == F.col("k")) & (F.col("a") == F.col("f")) & (F.col("b") == F.col("t"))
    later = cut(found.select("id", "key", *_UNIT).join(firsts.hint("merge"), is_first, "left_anti"))
    run = F.col("j") - F.row_number().over(Window.partitionBy("id", "key").orderBy("j"))
    pairs = later.where("kind = 1").dropDuplicates(["id", "key", "j"]).withColumn("run", run)  # equal rows of docs have given them more than once
    runs = pairs.groupBy("id", "key", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), (F.sum("w1") + F.max_by("w2", "j")).alias("n")).where(F.col("n") >= words)
    gone = later.where("kind = 0").select("id", "key", "a", "b").unionByName(runs.select("id", "key", "a", "b"))
    return cut(gone.groupBy("id", "key").agg(F.collect_set(F.struct("a", "b")).alias("gone")))


def dedup_lines(docs: DataFrame, cut_at: int = CUT, words: int = WORDS, count: str = "n_removed") -> DataFrame:
    """docs (doc_id, text, ...) with repeated chunks and runs taken out of text, and a column that counts the lines that went."""
    columns = docs.columns
    count, key, gone_at, doc, of = (common.free_name(docs, c) for c in (count, "text_key", "gone", "doc", "of"))
    own = docs.withColumn(key, F.unhex(F.md5("text")))
    named = own.select(F.col("doc_id").alias("id"), F.col(key).alias("key"), "text").where("text is not null")
    gone = _repeated(named, cut_at, words).select(F.col("id").alias(doc), F.col("key").alias(of), F.col("gone").alias(gone_at))
    out = own.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(of)), "left")
    numbers = f"array_distinct(flatten(transform(`{gone_at}`, r -> sequence(r.a, r.b))))"
    left = rf"transform(array(split(text, '\n', -1)), lines -> array_join(transform(array_except(sequence(0, size(lines) - 1), {numbers}), i -> lines[i]), '\n'))[0]"
    text = F.when(F.col(gone_at).isNull(), F.col("text")).otherwise(F.expr(left)).alias("text")
    removed = F.when(F.col(gone_at).isNull(), F.lit(0)).otherwise(F.expr(f"size({numbers})"))
    return out.select(*[text if c == "text" else F.col(f"`{c}`") for c in columns], removed.alias(count))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: what is left of its text, by size and checksum, and how many lines went."""
    done = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("n_removed").cast("int").alias("n_removed"), F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


ORACLE = rf"""
with docs as (select distinct doc_id, text, md5(text) as key from documents where text is not null),
lines as (select doc_id, key, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
marked as (select *, md5(line) as h, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from lines),
ends as (
  select *, lead(h) over d is null or w >= {WORDS} or lead(w) over d >= {WORDS} or ('0x' || substr(md5(h || lead(h) over d), 1, 2))::int % {CUT} = 0 as ends
  from marked window d as (partition by doc_id, key order by i)),
numbered as (select *, coalesce(sum(ends::int) over (partition by doc_id, key order by i rows between unbounded preceding and 1 preceding), 0) as pos from ends),
chunks as (select doc_id, key, min(i) as a, max(i) as b, string_agg(line, chr(10) order by i) as chunk from numbered group by doc_id, key, pos having (count(*) > 1 or max(w) >= {WORDS}) and max(w) > 0),
gone_chunks as (select doc_id, key, a, b from chunks qualify row_number() over (partition by chunk order by doc_id nulls last, key, a) > 1),
wordy as (select *, row_number() over (partition by doc_id, key order by i) as j from marked where w > 0),
pairs as (select doc_id, key, j, i as a, lead(i) over d as b, line as x, lead(line) over d as y, w as w1, lead(w) over d as w2 from wordy window d as (partition by doc_id, key order by i)),
later as (select * from pairs where b is not null qualify row_number() over (partition by x, y order by doc_id nulls last, key, a) > 1),
runs as (select *, j - row_number() over (partition by doc_id, key order by j) as run from later),
gone as (select * from gone_chunks union all select doc_id, key, min(a), max(b) from runs group by doc_id, key, run having sum(w1) + max_by(w2, j) >= {WORDS}),
numbers as (select distinct doc_id, key, unnest(range(a, b + 1)) as i from gone),
left_over as (
  select l.doc_id, l.key, count(n.i) as n_removed, coalesce(string_agg(line, chr(10) order by l.i) filter (n.i is null), '') as rest
  from lines l left join numbers n on n.doc_id is not distinct from l.doc_id and n.key = l.key and n.i = l.i group by all)
select d.doc_id, coalesce(n_removed, 0)::int as n_removed, strlen(coalesce(rest, d.text))::bigint as n_bytes, md5(coalesce(rest, d.text)) as text_md5
from documents d left join left_over l on d.doc_id is not distinct from l.doc_id and md5(d.text) = l.key
"""
