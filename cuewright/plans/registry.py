"""Every query of the engine and the DuckDB statement that must give the same rows.

Queries run over whole tables. ``collapse_repeats`` has no statement, which would list all units at all
places of whole documents; ``collapse_turns`` is the same operator on shorter texts, with one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.functions import kernels
from cuewright.functions import text as X
from cuewright.operators import corpus, dedup, layout, quality, recurrent, segment
from cuewright.plans import statements
from cuewright.plans.inputs import FRAMES, UTTERANCES, frames, pairs, utterances
from cuewright.scratch import scratch_dir
from cuewright.session import table
from cuewright.sources import corpus as sources
from cuewright.sources import files, models, srt
from cuewright.streaming import segments as streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

_WS, _sub, _utrim = statements.WS, statements.sub, statements.utrim
_P = X.PUNCT
_SEGS = "select source_id, start_frame, end_frame"


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- text scalars


@_query(f"select doc_id, {_sub('text', _P + _WS)} as stripped from documents")
def strip_punct(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.strip_punct("text").alias("stripped"))


@_query()
def collapse_repeats(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.collapse_repeats("text").alias("collapsed"))


@_query(f"with recursive {statements.collapse_ctes('c', '(select conv_id || chr(58) || turn as id, text as s from conversations where text is not null)')} select conv_id, turn, r as collapsed from conversations left join c on c.id = conv_id || chr(58) || turn")
def collapse_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.collapse_repeats("text").alias("collapsed"))


@_query(f"select doc_id, regexp_matches({_sub('text', _P + _WS)}, '^[{X.FILLERS}]+$') as filler from documents")
def filler_flag(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.is_pure_filler(X.strip_punct("text")).alias("filler"))


@_query(
    f"select doc_id, length(text) + length({_sub('text', X.WIDE, True)}) as width, "
    rf"length(text) + length({_sub('text', r'\x{2E81}-\x{10FFFF}', True)}) as qa_width from documents"
)
def display_width(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.display_width("text").alias("width"), X.qa_width("text").alias("qa_width"))


@_query(
    f"select doc_id, case when n = 0 then 0.0 else length({_sub('s', X.KANA, True)}) / n end as kana, "
    f"case when n = 0 then 0.0 else length({_sub('s', X.CJK, True)}) / n end as cjk, "
    f"length({_sub('s', 'a-zà-ÿ', True)}) / greatest(1, n) as lower "
    f"from (select doc_id, s, length(s)::double as n from (select doc_id, {_sub('text', _WS)} as s from documents))"
)
def script_ratios(spark, sf_dir):
    return _docs(spark, sf_dir).select(
        "doc_id", X.script_ratio("text", X.KANA).alias("kana"), X.script_ratio("text", X.CJK).alias("cjk"), X.script_ratio("text", "a-zà-ÿ", floor=True).alias("lower")
    )


@_query("select doc_id, left(text, 60) || case when length(text) > 60 then '…' else '' end as head, replace(text, chr(10), ' ') as flat from documents")
def truncate_flatten(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.truncate("text", 60).alias("head"), X.flatten_lines("text").alias("flat"))


@_query(r"select doc_id, regexp_replace(text, '[。.、！？!?]+$', '') as bare from documents")
def rstrip_marks(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.rstrip_sentence_marks("text").alias("bare"))


@_query(
    f"select doc_id, lang, body, body as after from (select doc_id, lang, {_utrim('text')} as body, text from documents)".replace("body as after", f"{_utrim('text')} as after")
)
def parse_tagged(spark, sf_dir):
    raw = F.concat(F.lit(" language "), F.col("lang"), F.lit(f" {X.TAG} "), F.col("text"))
    p = _docs(spark, sf_dir).withColumn("raw", raw).withColumn("p", X.parse_tagged("raw"))
    return p.select("doc_id", X.parse_tagged_strict("raw").alias("lang"), F.col("p.text").alias("body"), X.utrim(X.after_tag("raw")).alias("after"))


@_query(
    "select doc_id, list_aggregate(list_transform(range(1, 13), lambda i: list_extract(["
    + ", ".join(f"'{w}'" for w in X.STUB_WORDS)
    + "], (strpos('0123456789abcdef', substr(sha1(text), i::bigint, 1)) - 1) % 8 + 1)), 'string_agg', '') as target, sha1(text) as key from documents"
)
def stub_translate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.stub_translate("text").alias("target"), F.sha1("text").alias("key"))


@_query("select page_id, regexp_extract(html || ' BV1xx411c7' || lpad(cast(page_id as varchar), 9, '0'), '(BV[0-9A-Za-z]{10})', 1) as media, split_part(url, '.', 1) as family from pages")
def media_ids(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    shown = F.concat("html", F.lit(" BV1xx411c7"), F.lpad(F.col("page_id").cast("string"), 9, "0"))
    return p.select("page_id", X.media_id(shown).alias("media"), X.codec_family("url").alias("family"))


@_query(
    "select item_id, '<|im_start|>system' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || "
    "'<|audio_start|><|audio_pad|><|audio_end|><|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) as prompt from benchmark"
)
def chat_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.chat_prompt("text").alias("prompt"))


# ---- segmentation

_TRACK = f"""with f as {FRAMES}, n as (select source_id, max(frame_idx) + 1 as n from f group by 1),
g as (select *, frame_idx - lag(frame_idx) over w - 1 as gap from f where prob >= $THR window w as (partition by source_id order by frame_idx)),
i as (select *, sum(case when gap is null or gap >= $GAP then 1 else 0 end) over (partition by source_id order by frame_idx) as isl from g),
s as (select source_id, isl, min(frame_idx) as a, max(frame_idx) + 1 as b from i group by 1, 2),
e as (select s.source_id, a, case when isl = max(isl) over (partition by s.source_id) and n - b < $SILENCE then n else b end as b, n from s join n using (source_id)),
k as (select * from e where b - a >= $SPEECH)"""


def _track(gap: int, silence: int, speech: int, threshold: float = 0.5) -> str:
    return _TRACK.replace("$THR", str(threshold)).replace("$GAP", str(gap)).replace("$SILENCE", str(silence)).replace("$SPEECH", str(speech))


# The tables' values are small and alternate quickly, so these limits are lower than the defaults.
_LOW = 0.1
_L = segment.Limits(threshold=_LOW, min_speech=2, min_silence=3, merge_gap=2, pad=2)
_SPLIT = segment.Limits(threshold=_LOW, min_speech=2, min_silence=2, merge_gap=4, pad=2, max_seg=8)


@_query(_track(15, 15, 7) + "select source_id, greatest(a - 3, 0) as start_frame, least(b + 3, n) as end_frame from k")
def vad_default(spark, sf_dir):
    return segment.track(frames(spark, sf_dir))


@_query(_track(3, 3, 2, _LOW) + "select source_id, greatest(a - 2, 0) as start_frame, least(b + 2, n) as end_frame, greatest(a - 2, 0) * 512 * 1000 // 16000 as start_ms, least(b + 2, n) * 512 * 1000 // 16000 as end_ms from k")
def vad_segments(spark, sf_dir):
    return segment.bounds_ms(segment.track(frames(spark, sf_dir), _L))


@_query(
    _track(2, 2, 2, _LOW)
    + """, m as (select *, case when lag(b) over w is null or a - lag(b) over w >= 4 then 1 else 0 end as o from k window w as (partition by source_id order by a)),
r as (select *, sum(o) over (partition by source_id order by a) as run from m),
q as (select source_id, greatest(min(a) - 2, 0) as a, least(max(b) + 2, max(n)) as b from r group by source_id, run),
z as (select *, case when b - a > 8 then (b - a) // 8 + 1 else 1 end as c from q)
select source_id, a + i * ((b - a) // c) as start_frame, case when i + 1 = c then b else a + (i + 1) * ((b - a) // c) end as end_frame
from z, lateral (select unnest(range(c)) as i)"""
)
def vad_batch(spark, sf_dir):
    return segment.merge_pad_split(segment.mask(frames(spark, sf_dir), _SPLIT), _SPLIT)


_CAPPED = segment.Limits(threshold=_LOW, min_speech=2, min_silence=3, merge_gap=4, pad=2, max_seg=8)


@_query(statements.capped_sql(FRAMES, _CAPPED))
def vad_capped(spark, sf_dir):
    return segment.track_capped(frames(spark, sf_dir), _CAPPED)


@_query(
    _track(3, 3, 2, _LOW)
    + """select k.source_id, greatest(a - 2, 0) as start_sample, array_to_string(p[greatest(a - 2, 0) + 1:least(b + 2, n)], ' ') as samples
from k join (select source_id, list(cast(round(prob * 50000) as bigint) order by frame_idx) as p from f group by 1) using (source_id)"""
)
def vad_cut(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("sample", F.round(F.col("prob") * 50_000).cast("long"))
    block = F.expr("frame_idx div 64")
    audio = f.groupBy("source_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame_idx", "sample"))).alias("x")).select("source_id", "block", F.col("x.sample").alias("samples"))
    cut = segment.cut_samples(segment.track(f, _L), audio, 1, 64)
    return cut.select("source_id", "start_sample", F.array_join(F.col("samples").cast("array<string>"), " ").alias("samples"))


@_query(
    f"""with recursive seg as ({statements.capped_sql(FRAMES, _CAPPED)}), p as (select source_id, list(cast(round(prob * 50000) as bigint) order by frame_idx) as p from {FRAMES} group by 1)
select source_id, start_frame as start_sample, array_to_string(p[start_frame + 1:end_frame], ' ') as samples from seg join p using (source_id)"""
)
def stream_cuts(spark, sf_dir):
    """The capped tracker's segments with their samples, from a stream of frames: one sample a frame, and a row at each source's end."""
    f = frames(spark, sf_dir).withColumn("samples", F.array(F.round(F.col("prob") * 50_000).cast("float")))
    ends = f.groupBy("source_id").agg((F.max("frame_idx") + 1).alias("frame_idx"), F.lit(None).cast("double").alias("prob"), F.lit(None).cast("array<float>").alias("samples"))
    home = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    f.unionByName(ends).write.parquet(f"{home}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, streams.STATE_STORE)
    try:
        arriving = spark.readStream.schema(f.select("source_id", "frame_idx", "prob", "samples").schema).parquet(f"{home}/in")
        cut = streams.cut_stream(arriving, _CAPPED, frame_samples=1)
        cut.writeStream.format("parquet").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start(f"{home}/out").awaitTermination()
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(cut.schema).parquet(f"{home}/out")
    return out.select("source_id", "start_sample", F.array_join(F.transform("samples", lambda x: x.cast("long").cast("string")), " ").alias("samples"))


@_query(
    """with s as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 12 hour then 1 else 0 end as o from events window w as (partition by user_id order by ts)),
i as (select *, sum(o) over (partition by user_id order by ts) as g from s)
select user_id, count(*) as n_events, min(ts) as first_ts, max(ts) as last_ts from i group by user_id, g"""
)
def session_events(spark, sf_dir):
    return segment.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 12 * 3_600_000)


# ---- layout and cues

_PIECES = f"regexp_extract_all(replace(text, chr(10), ' '), '[^{layout.STOPS}]*[{layout.STOPS}]|[^{layout.STOPS}]+')"


@_query(f"select doc_id, p as piece, pieces[p + 1] as text from (select doc_id, pieces, unnest(range(len(pieces))) as p from (select doc_id, {_PIECES} as pieces from documents))")
def sentence_pieces(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.posexplode(layout.sentence_pieces(X.flatten_lines("text"))).alias("piece", "text"))
    return d.select("doc_id", F.col("piece").cast("long").alias("piece"), "text")


@_query(
    "select doc_id, list_aggregate(list_filter(list_transform(range(c), lambda k: "
    + _utrim("substr(text, n * k // c + 1, n * (k + 1) // c - n * k // c)")
    + "), lambda s: s <> ''), 'string_agg', '|') as parts from (select doc_id, text, length(text) as n, greatest(1, least(7, length(text))) as c from documents)"
)
def split_even(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(layout.split_even(F.col("text"), F.lit(7)), "|").alias("parts"))


@_query(f"with {statements.split_ctes('c', UTTERANCES)} select source_id, seq, piece, start_ms, end_ms, text from c")
def split_long_cues(spark, sf_dir):
    return layout.split_long_cues(utterances(spark, sf_dir)).select("source_id", "seq", "piece", "start_ms", "end_ms", "text")


@_query(f"with recursive {statements.wrap_ctes('w', '(select doc_id as id, text as t from documents)')} select id as doc_id, wrapped from w")
def wrap_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", layout.wrap_text("text").alias("wrapped"))


@_query(
    f"""with recursive {statements.split_ctes('c', UTTERANCES)}, k as (select *, source_id || ':' || seq || ':' || piece as id from c),
{statements.wrap_ctes('w', '(select id, text as t from k)')}
select source_id, row_number() over (partition by source_id order by seq, piece) as index, start_ms, end_ms, t as text from (select k.*, {_utrim('wrapped')} as t from k join w using (id)) where t <> ''"""
)
def layout_cues(spark, sf_dir):
    return layout.layout(utterances(spark, sf_dir)).select("source_id", "index", "start_ms", "end_ms", "text")


_TS = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_SRT = (
    f"select source_id, string_agg(cast(n as varchar) || chr(10) || {_TS.format('start_ms')} || ' --> ' || {_TS.format('end_ms')} || chr(10) || {_utrim('text')} || chr(10) || chr(10), '' order by n) as srt "
    f"from (select *, row_number() over (partition by source_id order by start_ms) as n from {UTTERANCES}) group by 1"
)


@_query(_SRT)
def srt_files(spark, sf_dir):
    return srt.render(utterances(spark, sf_dir))


@_query(f"select source_id, row_number() over (partition by source_id order by start_ms) as index, start_ms, end_ms, text from (select *, {_utrim('text')} as t from {UTTERANCES}) where t <> ''".replace("end_ms, text from", "end_ms, t as text from"))
def srt_roundtrip(spark, sf_dir):
    return srt.parse(srt.render(utterances(spark, sf_dir)))


@_query(f"select source_id, row_number() over (partition by source_id order by start_ms) as index, start_ms, end_ms, t as text from (select *, {_utrim('text')} as t from {UTTERANCES}) where t <> ''")
def srt_written(spark, sf_dir):
    """The files, written and read again."""
    path = f"{scratch_dir(spark)}/srt-{uuid.uuid4().hex}"
    srt.write(utterances(spark, sf_dir), path)
    back = srt.parse(srt.read(spark, path))
    return back.withColumn("source_id", F.regexp_extract("source_id", r"(\d+)\.srt$", 1).cast("long"))


@_query(
    f"""select source_id, case when source_id % 9 < 2 then 0 else count_if({_utrim('text')} <> '') end::bigint as n_cues,
case source_id % 9 when 0 then 'not UTF-8' when 1 then 'no time line' end as error from {UTTERANCES} group by source_id"""
)
def files_with_errors(spark, sf_dir):
    """Subtitle files of which some are none: those are rows of their own, and the rest is read."""
    u = utterances(spark, sf_dir)
    rows = u.select(F.format_string("%d.srt", "source_id").alias("name"), "source_id", "seq", srt.block(F.col("seq"), F.col("start_ms"), F.col("end_ms"), F.col("text")).cast("binary").alias("content"))
    broken = F.when(F.col("source_id") % 9 == 0, F.unhex(F.lit("C328"))).when(F.col("source_id") % 9 == 1, F.lit("no cues").cast("binary")).otherwise(F.col("content"))
    path = f"{scratch_dir(spark)}/each-{uuid.uuid4().hex}"
    raw = rows.where("source_id % 2 = 0").withColumn("name", F.format_string("%d.raw.srt", "source_id"))  # variants that are left out
    files.write_named(rows.withColumn("content", broken).unionByName(raw), path, ("seq",))
    each = srt.read_each(spark, path)
    n = srt.parse(each.where("error is null")).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n"))
    read = each.join(n, F.col("source_id") == F.col("id"), "left")
    return read.select(F.regexp_extract("source_id", r"(\d+)\.srt$", 1).cast("long").alias("source_id"), F.coalesce("n", F.lit(0).cast("long")).alias("n_cues"), "error")


_MODEL_FILES = """(select p_brand as brand, p_size as rank, 'at/' || p_size as folder, case p_partkey % 4 when 0 then 'model.gguf' when 1 then 'mmproj-' || p_partkey || '.gguf' when 2 then p_partkey || '.gguf' else p_partkey || '.bin' end as name from part)"""


@_query(
    f"""with f as (select brand, rank, folder, max(name) filter (name = 'model.gguf') as best, count_if(g and not m) as n, min(name) filter (g and not m) as one, max(name) filter (name = 'mmproj.gguf') as best_a,
count_if(g and m) as n_a, min(name) filter (g and m) as one_a from (select *, ends_with(name, '.gguf') as g, starts_with(name, 'mmproj') as m from {_MODEL_FILES}) group by 1, 2, 3),
e as (select *, case when best is null and n > 1 then 'more than one language model' when best_a is null and n_a > 1 then 'more than one audio model' end as wrong from f),
c as (select brand, rank, folder, wrong, case when wrong is null then coalesce(best, case when n = 1 then one end) end as language, case when wrong is null then coalesce(best_a, case when n_a = 1 then one_a end) end as audio from e),
w as (select brand, arg_min(folder, rank) filter (ok) as folder, arg_min(language, rank) filter (ok) as language, arg_min(audio, rank) filter (ok) as audio, arg_min(wrong, rank) filter (wrong is not null) as wrong
from (select *, language is not null and audio is not null as ok from c) group by 1)
select brand, folder, language, audio, case when folder is null then coalesce(wrong, 'no model') end as error from w"""
)
def model_choice(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, "model.gguf").when(key % 4 == 1, F.format_string("mmproj-%d.gguf", key)).when(key % 4 == 2, F.format_string("%d.gguf", key)).otherwise(F.format_string("%d.bin", key))
    listed = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("rank"), F.format_string("at/%d", "p_size").alias("folder"), name.alias("name"))
    return models.choose(listed, "brand")


def _judged(spark, sf_dir):
    u = utterances(spark, sf_dir).withColumn("raw", F.concat(F.lit("language "), F.when(F.col("role") == "user", "None").otherwise("English"), F.lit(X.TAG), F.col("text")))
    return dedup.segment_verdicts(u)


_RAW = f"(select source_id, seq, start_ms, end_ms, case when role = 'user' then 'None' else 'English' end as lang, text from {UTTERANCES})"
_SEGMENTS = "with recursive " + statements.segments_ctes(_RAW)
_JUDGED = f"""{_SEGMENTS}, {statements.split_ctes('sp', "(select source_id, seq, start_ms, end_ms, text from judged where verdict = 'process')")}, {statements.verdict_ctes('cues', 'sp')}"""


@_query(_SEGMENTS + " select * from judged")
def segment_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir)


def _cues(spark, sf_dir):
    kept = _judged(spark, sf_dir).where("verdict = 'process'").select("source_id", "seq", "start_ms", "end_ms", "text")
    return dedup.cue_verdicts(layout.split_long_cues(kept))


@_query(_JUDGED + " select source_id, seq, piece, start_ms, end_ms, text, verdict from cues")
def cue_verdicts(spark, sf_dir):
    return _cues(spark, sf_dir)


@_query(
    _JUDGED
    + """ select source_id, n_segs, n_empty + coalesce(e, 0) as n_empty, n_frag, n_collapsed, coalesce(d, 0) as n_dup, coalesce(f, 0) as n_filler, coalesce(k, 0) as n_kept from
(select source_id, count(*) as n_segs, count(*) filter (verdict = 'empty') as n_empty, count(*) filter (verdict = 'fragment') as n_frag, count(*) filter (collapsed) as n_collapsed from judged group by 1)
left join (select source_id, count(*) filter (verdict = 'empty') as e, count(*) filter (verdict = 'duplicate') as d, count(*) filter (verdict = 'filler_repeat') as f, count(*) filter (verdict = 'keep') as k from cues group by 1) using (source_id)"""
)
def transcript_counters(spark, sf_dir):
    return dedup.counters(_judged(spark, sf_dir), _cues(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances to subtitle cues: clean, split, drop what repeats, number, format the times."""
    cues = dedup.kept_cues(_cues(spark, sf_dir))
    return cues.select("source_id", F.col("index").cast("long").alias("index"), X.format_timestamp("start_ms").alias("start"), X.format_timestamp("end_ms").alias("end"), "text")


@_query(
    f"""{_JUDGED} select source_id, row_number() over (partition by source_id order by seq, piece) as index, {_TS.format('start_ms')} as start, {_TS.format('end_ms')} as "end", text from cues where verdict = 'keep'"""
)
def subtitles(spark, sf_dir):
    return flagship(spark, sf_dir)


# ---- training sets

_BARE = r"regexp_replace({}, '[。.、！？!?]+$', '')"


@_query(
    f"""with d as (select doc_id, lang, text, {_utrim('text')} as k from documents), t as (select text as src, 'T' || item_id as dst, item_id from benchmark),
e as (select src, arg_max(dst, item_id) as dst, min(item_id) as l from t group by 1), z as (select {_BARE.format('src')} as b, arg_min(dst, l) as dst from e group by 1)
select d.doc_id, coalesce(e.dst, z.dst) as target, case when e.dst is not null then 'exact' when z.dst is not null then 'loose' else 'miss' end as match
from d left join e on e.src = d.k left join z on z.b = {_BARE.format('d.k')}"""
)
def lookup(spark, sf_dir):
    return corpus.translate(_docs(spark, sf_dir).select("doc_id", "text"), pairs(spark, sf_dir)).select("doc_id", "target", "match")


@_query(f"select doc_id, lang from documents where {_utrim('text')} not in (select text from benchmark where text is not null)")
def lookup_missing(spark, sf_dir):
    return corpus.missing(_docs(spark, sf_dir), pairs(spark, sf_dir)).select("doc_id", "lang")


@_query("select d.doc_id, d.source, l.quality, l.toxic from documents d join labels l using (doc_id) where d.n_chars between 100 and 5000")
def labelled_range(spark, sf_dir):
    rows = corpus.within_duration(_docs(spark, sf_dir), 5000, 100, "n_chars")
    return rows.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


# Every row draws once from the seeded generator, in order; a twentieth as many silent samples are put behind them.
_DRAWN = f"""{statements.twister_ctes('g', 7, '(select count(*) from documents)')},
p as (select d.*, draw from (select *, row_number() over (order by doc_id) - 1 as position, (select count(*) from documents) * 9 // 10 as lim from documents) d join g using (position))"""


@_query(f"with recursive {_DRAWN} select doc_id, position, draw from p")
def task_draws(spark, sf_dir):
    rows = corpus.position(_docs(spark, sf_dir).select("doc_id"), ["doc_id"])
    return corpus.with_draws(rows.withColumn("position", F.col("position").cast("long")), 7)


@_query(
    f"""with recursive {_DRAWN},
r as (select doc_id, 'train' as split, case when draw >= 0.3 then 'translate' else 'transcribe' end as task, text, lang from p where position < lim
union all select doc_id, 'eval', t, text, lang from p, (values ('translate'), ('transcribe')) v(t) where position >= lim)
select doc_id, split, 'd' || doc_id || '.wav' as audio, task, 'language Japanese<asr_text>' || case when task = 'translate' then upper(lang) else text end as text,
case when task = 'translate' then 'to zh' else '' end as prompt from r"""
)
def training_records(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    rows = corpus.position(docs.select(F.col("doc_id").alias("row_id"), "text", F.upper("lang").alias("target"), F.format_string("d%d.wav", "doc_id").alias("audio")), ["row_id"])
    return corpus.records(rows, docs.count() * 9 // 10, 0.3, 7, "to zh").withColumnRenamed("row_id", "doc_id")


@_query(
    f"""with recursive {_DRAWN}
select split, task, count(*) as n from (select 'train' as split, case when draw >= 0.3 then 'translate' else 'transcribe' end as task from p where position < lim
union all select 'eval', t from p, (values ('translate'), ('transcribe')) v(t) where position >= lim) group by 1, 2"""
)
def training_mix(spark, sf_dir):
    return corpus.composition(training_records(spark, sf_dir))


_ROWS = f"""{_DRAWN},
q as (select *, position >= lim as ev, case when lang <> 'de' then upper(lang) end as target, position >= lim or draw >= 0.3 as mt from p)"""


def _some_targets(spark, sf_dir):
    """Rows of which some have no target, and the position from which on they are for evaluation."""
    docs = _docs(spark, sf_dir)
    rows = docs.select(F.col("doc_id").alias("row_id"), "text", F.when(F.col("lang") != "de", F.upper("lang")).alias("target"), F.format_string("d%d.wav", "doc_id").alias("audio"))
    return corpus.position(rows, ["row_id"]), docs.count() * 9 // 10


_SILENCE = "select i as j, {}i % 2 = 0 as zeros, printf('silence_%03d.wav', i) as audio, 'language None<asr_text>' as text, case when (i < 4 and i < 2) or (i >= 4 and i // 2 % 2 = 0) then 'to zh' else '' end as prompt from range((select count(*) // 20 from documents)) t(i)"


def _silence(spark, sf_dir):
    return corpus.silence_rows(spark, _docs(spark, sf_dir).count() // 20, "to zh", 0.5, 5.0, 7)


@_query(
    f"""with recursive {_ROWS} select doc_id, case when ev then 'eval' else 'train' end as split, 'd' || doc_id || '.wav' as audio, task, 'language Japanese<asr_text>' || case when task = 'translate' then target else text end as text,
case when task = 'translate' then 'to zh' else '' end as prompt from (select *, unnest(case when ev then ['translate', 'transcribe'] when mt then ['translate'] else ['transcribe'] end) as task from q where not mt or target is not null)
union all select -1, 'train', audio, 'silence', text, prompt from ({_SILENCE.format('')})"""
)
def training_set(spark, sf_dir):
    rows, limit = _some_targets(spark, sf_dir)
    made = corpus.records(rows, limit, 0.3, 7, "to zh")
    return corpus.with_silence(made, _silence(spark, sf_dir)).select(F.coalesce("row_id", F.lit(-1)).alias("doc_id"), "split", "audio", "task", "text", "prompt")


@_query(f"with recursive {_ROWS} select count(*) filter (mt and target is not null) as n_mt, count(*) filter (not mt) as n_asr, count(*) filter (mt and target is null) as n_skipped, count(*) // 20 as n_silence from q")
def training_counts(spark, sf_dir):
    return corpus.counters(*_some_targets(spark, sf_dir), 0.3, 7, _docs(spark, sf_dir).count() // 20)


@_query("select doc_id, trim(case when doc_id % 3 = 0 or text = '' then lang else text end) as text from documents where n_chars between 200 and 2000 and (doc_id % 5 > 0) order by doc_id limit 100")
def labelled_first(spark, sf_dir):
    rows = _docs(spark, sf_dir).withColumns({"transcription": F.when(F.col("doc_id") % 3 != 0, F.col("text")), "raw_transcription": F.when(F.col("doc_id") % 5 != 0, F.col("lang"))})
    rows = corpus.within_duration(rows.where("doc_id % 5 > 0"), 2000, 200, "n_chars")
    return corpus.first_rows(corpus.labelled_text(rows.drop("text")), ["doc_id"], 100).select("doc_id", "text")


@_query("select doc_id, lang as text from documents where doc_id % 3 > 0 and n_chars / 16.0 <= 60")
def transcribed_files(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    files = docs.select("doc_id", F.format_string("wav/d.%d.wav", "doc_id").alias("path"), (F.col("n_chars") / 16.0).alias("secs"))
    key = F.when(F.col("doc_id") % 2 == 0, F.format_string("d.%d", "doc_id")).otherwise(F.format_string("d.%d.wav", "doc_id"))
    found = corpus.join_transcripts(files, docs.where("doc_id % 3 > 0").select(key.alias("key"), F.col("lang").alias("text")))
    return corpus.within_duration(found, 60, None).select("doc_id", "text")


@_query("select doc_id, n_chars from documents where doc_id not in (select doc_id from labels) order by n_chars, doc_id limit 30")
def next_untaken(spark, sf_dir):
    return sources.untaken(_docs(spark, sf_dir).select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id", "n_chars", 30)


@_query(
    """select doc_id, pass from (select doc_id, case when n_chars between 500 and 900 then 1 when lang = 'de' then 2 end as pass from documents) where pass is not null
order by pass, doc_id desc limit (select count(*) // 4 from documents)"""
)
def two_passes(spark, sf_dir):
    """Candidates from the last one on until a quarter of their number is there, by a first way and then by another."""
    docs = _docs(spark, sf_dir).withColumn("rank", -F.col("doc_id"))
    found = sources.in_passes(docs, [F.col("n_chars").between(500, 900), F.col("lang") == "de"], "rank", docs.count() // 4)
    return found.select("doc_id", F.col("pass").cast("long").alias("pass"))


@_query("select lang, arg_min(source, doc_id) filter (n_chars > 5000) as first from documents group by 1")
def first_complete(spark, sf_dir):
    return corpus.first_match(_docs(spark, sf_dir), "lang", "source", "doc_id", F.col("n_chars") > 5000)


@_query("select 'd' || doc_id || '.wav' as audio, 'language ' || lang || '<asr_text>' || text as text, case when doc_id % 2 = 0 then 'to zh' else '' end as prompt from documents")
def records_written(spark, sf_dir):
    """Training records, written as JSON lines and read again."""
    text = F.concat(F.lit("language "), "lang", F.lit(X.TAG), "text").alias("text")
    rows = _docs(spark, sf_dir).select(F.format_string("d%d.wav", "doc_id").alias("audio"), text, F.when(F.col("doc_id") % 2 == 0, "to zh").otherwise("").alias("prompt"))
    path = f"{scratch_dir(spark)}/records-{uuid.uuid4().hex}"
    sources.write_records(rows, path)
    return sources.read_records(spark, path)


_FLAT = "replace(text, chr(10), ' ')"


@_query(f"select {_utrim(_FLAT)} as line, count(*) as n from documents group by 1")
def transcripts_dumped(spark, sf_dir):
    """One line a document, before any filter, written as text and read again as a log is."""
    path = f"{scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    sources.dump_transcripts(_docs(spark, sf_dir), path)
    return sources.log_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@_query("select p_partkey as name, p_partkey // 1 as start, p_partkey + p_size <= 1000 as ok from part")
def weight_layout(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") * 4).alias("offset"), F.col("p_size").alias("len"))
    return sources.weight_layout(parts, 1000).select("name", "start", "ok")


@_query("select doc_id, octet_length(encode(text)) // 4 as n_samples from documents")
def pcm_sizes(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return sources.pcm_samples(files).select(F.col("source_id").cast("long").alias("doc_id"), F.size("samples").cast("long").alias("n_samples"))


@_query(
    """select label, row_number() over (partition by label order by vec_id, i) - 1 as at, v::double as value
from (select vec_id, label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings)"""
)
def pcm_values(spark, sf_dir):
    """Sample files, one for each label with some bytes behind its last sample, read in ranges that cut samples."""
    e = table(spark, sf_dir, "embeddings")
    name = F.format_string("%d.pcm", "label").alias("name")
    rows = files.pcm_bytes(e.select(name, "vec_id", F.col("embedding").alias("samples")))
    rest = e.groupBy(name).agg(F.lit(None).cast("long").alias("vec_id"), F.unhex(F.repeat(F.lit("ff"), F.any_value("label") % 4)).alias("content"))
    path = f"{scratch_dir(spark)}/pcm-{uuid.uuid4().hex}"
    files.write_named(rows.unionByName(rest).withColumn("last", F.col("vec_id").isNull()), path, ("last", "vec_id"))
    samples = files.read_pcm(spark, path, 50_001).select("source_id", "first_sample", F.posexplode("samples").alias("at", "value"))
    label = F.regexp_extract("source_id", r"(-?\d+)\.pcm$", 1).cast("int")
    return samples.select(label.alias("label"), (F.col("first_sample") + F.col("at")).alias("at"), F.col("value").cast("double").alias("value"))


@_query("""select lang, '{"lang":"' || lang || '","n":' || count(*) || ',"longest":' || max(n_chars) || ',"none":null}' as json from documents group by 1""")
def report_json(spark, sf_dir):
    m = _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.lit(None).cast("string").alias("none"))
    return sources.report_json(m).select(F.get_json_object("json", "$.lang").alias("lang"), "json")


@_query(
    r"""select page_id, regexp_extract(url, '^(.*/)?', 0) || stem || '.srt' as beside, 'out/' || stem || '.raw.srt' as raw
from (select *, case when regexp_matches(name, '^.+\.[^.]*$') then regexp_replace(name, '\.[^.]*$', '') else name end as stem from (select *, regexp_extract(url, '([^/]*)$', 1) as name from pages))"""
)
def output_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", srt.output_name(F.col("url")).alias("beside"), srt.output_name(F.col("url"), raw=True, folder="out").alias("raw"))


@_query(_SILENCE.format("round(case when i < 4 then 2.0 else 0.5 + cast('0x' || substr(sha1('7:' || i), 1, 8) as bigint) / 4294967296.0 * 4.5 end, 2) as secs, "))
def silence_lengths(spark, sf_dir):
    return _silence(spark, sf_dir)


@_query("select i as j, i % 2 = 0 as zeros, printf('silence_%03d.wav', i) as audio, 'language None<asr_text>' as text, case when (i < 4 and i < 2) or (i >= 4 and i // 2 % 2 = 0) then 'to zh' else '' end as prompt from range((select count(*) // 20 from documents)) t(i)")
def silence_rows(spark, sf_dir):
    return _silence(spark, sf_dir).drop("secs")


@_query(
    """select src, arg_max(dst, n) as dst from (select regexp_replace(split_part(line, chr(9), 1), '^ +| +$', '', 'g') as src, regexp_replace(substr(line, strpos(line, chr(9)) + 1), '^ +| +$', '', 'g') as dst, n
from (select doc_id as n, case when doc_id % 10 = 0 then '#' else '' end || source || ' ' || chr(9) || ' ' || lang || chr(9) || doc_id as line from documents) where line not like '#%') group by 1"""
)
def parallel_pairs(spark, sf_dir):
    line = F.concat(F.when(F.col("doc_id") % 10 == 0, "#").otherwise(""), "source", F.lit(" \t "), "lang", F.lit("\t"), F.col("doc_id").cast("string"))
    lines = _docs(spark, sf_dir).select(F.col("doc_id").alias("line_no"), line.alias("line"))
    return corpus.last_wins(sources.parallel_pairs(lines)).select("src", "dst")


@_query("with c as (select sha1(text) as k, arg_max(lang || doc_id, doc_id) as v from documents where lang = 'en' group by 1) select doc_id, c.v as hit from documents d left join c on c.k = sha1(d.text)")
def cache_lookup(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    line = F.to_json(F.struct(F.sha1("text").alias("k"), F.concat("lang", F.col("doc_id").cast("string")).alias("v")))
    lines = docs.where("lang = 'en'").select(F.col("doc_id").alias("line_no"), line.alias("line"))
    return sources.cached(docs.select("doc_id", "text"), sources.cache(lines)).select("doc_id", "hit")


# ---- quality

_CUES = f"(select source_id, start_ms / 1000.0 as start_s, end_ms / 1000.0 as end_s, start_ms, text, {_sub('text', _WS)} as s, replace(text, chr(10), '') as flat from {UTTERANCES})"
_METRICS = f"""select source_id, count(*) as n_cues, sum(length({_sub('s', X.KANA, True)})) / greatest(sum(length(s)), 1) as kana, sum(length({_sub('s', X.CJK, True)})) / greatest(sum(length(s)), 1) as cjk,
greatest(0.05::double, max(end_s::double) / 60) as minutes, max(list_max(list_transform(string_split(text, chr(10)), lambda x: length(x) + length(regexp_replace(x, '[^\\x{{2E81}}-\\x{{10FFFF}}]', '', 'g'))))) as widest,
max(end_s::double - start_s::double) as longest, max(length(flat)) as most_chars, count_if(length({_utrim('flat')}) < 2)::bigint as n_skinny from {_CUES} group by 1"""


def _timed(spark, sf_dir):
    return utterances(spark, sf_dir).select("source_id", "start_ms", (F.col("start_ms") / 1000.0).alias("start_s"), (F.col("end_ms") / 1000.0).alias("end_s"), "text")


@_query(_METRICS.replace("max(end_s::double - start_s::double) as longest", "round(max(end_s::double - start_s::double), 6) as longest"))
def subtitle_metrics(spark, sf_dir):
    return quality.subtitle_metrics(_timed(spark, sf_dir)).withColumn("longest", F.round("longest", 6))


@_query(
    f"""with m as ({_METRICS}) select source_id, c."check", c.ok from m, lateral (values ('density', n_cues >= minutes * 4), ('kana', kana <= 0.05), ('cjk', cjk >= 0.5), ('width', widest <= 40),
('longest', longest <= 12.0), ('chars', most_chars <= 44), ('skinny', n_skinny = 0)) c("check", ok)"""
)
def subtitle_checks(spark, sf_dir):
    return quality.subtitle_checks(quality.subtitle_metrics(_timed(spark, sf_dir)))


@_query(f"select source_id, sum(length(text)) / greatest(0.05::double, max(end_s::double) / 60) as chars_per_min, count(*) / greatest(0.05::double, max(end_s::double) / 60) as cues_per_min from {_CUES} group by 1")
def subtitle_density(spark, sf_dir):
    return quality.density(_timed(spark, sf_dir))


@_query(f"select source_id, start_ms // 20000 as bucket, count(*) as n_cues, sum(length(text))::bigint as n_chars from {UTTERANCES} group by 1, 2")
def buckets_20s(spark, sf_dir):
    return quality.buckets(utterances(spark, sf_dir))


_RATIO = "(case when length(s) = 0 then 0.0::double else length({}) / length(s)::double end)"


@_query(
    f"""with r as (select source, lang = 'en' as mt, {_RATIO.format(_sub('s', X.KANA, True))} as kana, {_RATIO.format(_sub('s', X.CJK, True))} as cjk from (select *, {_sub('text', _WS)} as s from documents))
select source, avg(kana) filter (mt) as translated_kana, avg(cjk) filter (mt) as translated_cjk, avg(kana) filter (not mt) as transcribed_kana, (count(*) filter (not mt and kana < 0.05))::bigint as leaks,
avg(kana) filter (mt) <= 0.1 as translation_takes_effect, avg(kana) filter (not mt) >= 0.15 as no_forgetting from r group by 1"""
)
def eval_metrics(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("source", F.when(F.col("lang") == "en", "p").otherwise("").alias("prompt"), F.col("text").alias("out"))
    return quality.eval_checks(quality.eval_metrics(rows, ["source"]))


# Vowels are shown as kana and some letters as ideographs, so that shares are not nought and roundings matter.
_SHOWN = "translate(text, 'aeioutn', 'あいうえお字文')"


@_query(
    f"""with r as (select source, lang, round_even({_RATIO.format(_sub('s', X.KANA, True))}, 4) as kana, round_even({_RATIO.format(_sub('s', X.CJK, True))}, 4) as cjk from (select source, lang, {_sub(_SHOWN, _WS)} as s from documents))
select source, round_even(avg(kana) filter (lang = 'en'), 4) as kana, round_even(avg(cjk) filter (lang = 'en'), 4) as cjk, round_even(avg(kana) filter (lang <> 'en'), 4) as transcribed, count_if(lang <> 'en' and kana < 0.05)::bigint as leaks from r group by 1"""
)
def eval_report(spark, sf_dir):
    """The report's rounded form."""
    shown = F.translate("text", "aeioutn", "あいうえお字文")
    rows = _docs(spark, sf_dir).select("source", F.when(F.col("lang") == "en", "p").otherwise("").alias("prompt"), shown.alias("out"))
    found = quality.eval_metrics(rows, ["source"], report=True)
    return found.select("source", F.col("translated_kana").alias("kana"), F.col("translated_cjk").alias("cjk"), F.col("transcribed_kana").alias("transcribed"), "leaks")


@_query(f"select bool_and(length({_utrim('text')}) <= 2) as silence_is_empty from conversations")
def silence_check(spark, sf_dir):
    return quality.silence_check(table(spark, sf_dir, "conversations").select("text", F.lit(None).cast("string").alias("error")))


@_query(f"select source_id, row_number() over (partition by source_id order by start_ms) - 1 as seq, round(start_ms / 1000.0, 3) as start_s, round(end_ms / 1000.0, 3) as end_s, t as text from (select *, {_utrim('text')} as t from {UTTERANCES})")
def srt_strict(spark, sf_dir):
    found = srt.parse_strict(srt.render(utterances(spark, sf_dir)))
    return found.select("source_id", F.col("seq").cast("long").alias("seq"), F.round("start_s", 3).alias("start_s"), F.round("end_s", 3).alias("end_s"), "text")


_LINES = "(select doc_id as source_id, unnest(string_split(text, chr(10))) as line from documents)"


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("source_id"), F.explode(F.split("text", "\n")).alias("line"))


@_query(f"select source_id, marker, count(*) as n_lines from {_LINES}, (values ('token'), ('the'), ('que'), ('$$$')) m(marker) where contains(line, marker) and {_utrim('line')} <> '' group by 1, 2")
def noise_markers(spark, sf_dir):
    return quality.noise_hits(_lines(spark, sf_dir), ("token", "the", "que", "$$$"))


@_query(f"select source_id, marker, bool_or(contains(line, marker)) as found from {_LINES}, (values ('License'), ('the')) m(marker) group by 1, 2")
def required_markers(spark, sf_dir):
    return quality.required_markers(_lines(spark, sf_dir), ("License", "the"))


@_query(
    f"""with l as (select source_id, count_if({_utrim('line')} <> '')::bigint as n_lines, greatest(1, sum((length(line) - length(replace(line, 'the', ''))) // 3))::bigint as n_files,
sum(len(regexp_extract_all(line, '([0-9]{{1,6}})')))::bigint as n_found, coalesce(sum(list_sum(list_transform(regexp_extract_all(line, '([0-9]{{1,6}})', 1), lambda x: x::bigint))), 0)::bigint as n_kept from {_LINES} group by 1),
c as (select *, case when n_found > 0 then n_kept + 4 * n_files + 8 else 30 * n_files + 12 end as cap from l) select source_id, n_lines, n_files, n_kept, cap, n_lines <= cap as ok from c"""
)
def line_cap(spark, sf_dir):
    return quality.line_cap(_lines(spark, sf_dir), r"([0-9]{1,6})", "the")


@_query("select source, doc_id, rank from (select source, doc_id, row_number() over (partition by source order by doc_id desc) as rank from documents) where rank <= 25")
def last_per_source(spark, sf_dir):
    return quality.first_per_group(_docs(spark, sf_dir), "source", [F.desc("doc_id")], 25).select("source", "doc_id", "rank")


@_query("select l_partkey, arg_max(l_orderkey * 10 + l_linenumber, (l_quantity, -(l_orderkey * 10 + l_linenumber))) as best from lineitem group by 1")
def best_line(spark, sf_dir):
    own = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return quality.best_by(table(spark, sf_dir, "lineitem"), "l_partkey", own, F.col("l_quantity"), own)


@_query("select conv_id as source_id, avg((length(text) < 40)::int) as drop_rate from conversations group by 1")
def drop_rate(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "source_id")
    return quality.drop_rate(c, F.length("text") < 40)


# Some cues end early, some late, so that both faults are there.
_UNEVEN = f"(select source_id, start_ms, end_ms - case when length(text) % 5 = 0 then 10 * length(text) + 60000 when length(text) % 7 = 0 then -900 else 0 end as end_ms, text from {UTTERANCES})"


@_query(f"select source_id, count_if(end_ms <= start_ms)::bigint as n_backward, count_if(end_ms > nxt + 1)::bigint as n_overlap from (select *, lead(start_ms) over (partition by source_id order by start_ms, end_ms) as nxt from {_UNEVEN}) group by 1")
def cue_adjacency(spark, sf_dir):
    n = F.length("text")
    off = F.when(n % 5 == 0, 10 * n + 60_000).when(n % 7 == 0, -900).otherwise(0)
    return quality.adjacency(utterances(spark, sf_dir).withColumn("end_ms", F.col("end_ms") - off))


_TRACKS = f"l as (select source_id, start_ms, end_ms, text from {UTTERANCES}), r as (select source_id - 1 as source_id, start_ms, end_ms, text from {UTTERANCES})"
_TOGETHER = "least(l.end_ms, r.end_ms) - greatest(l.start_ms, r.start_ms)"


def _tracks(spark, sf_dir):
    """A conversation and the next one as two tracks of one source."""
    u = utterances(spark, sf_dir).select("source_id", "start_ms", "end_ms", "text")
    return u, u.withColumn("source_id", F.col("source_id") - 1)


@_query(
    f"""with {_TRACKS} select source_id, l.start_ms as left_start_ms, l.end_ms as left_end_ms, l.text as left_text, r.start_ms as right_start_ms, r.end_ms as right_end_ms,
r.text as right_text, {_TOGETHER} as overlap_ms from l join r using (source_id) where {_TOGETHER} > 0"""
)
def track_overlaps(spark, sf_dir):
    return quality.overlaps(*_tracks(spark, sf_dir))


@_query(
    f"""with {_TRACKS}, a as (select source_id, start_ms // 20000 as bucket, count(*) as n, string_agg(text, ' / ' order by start_ms, end_ms, text) as t from l group by 1, 2),
b as (select source_id, start_ms // 20000 as bucket, count(*) as n, string_agg(text, ' / ' order by start_ms, end_ms, text) as t from r group by 1, 2),
o as (select source_id, l.start_ms // 20000 as bucket, sum({_TOGETHER})::bigint as ms from l join r using (source_id) where {_TOGETHER} > 0 group by 1, 2)
select source_id, bucket, coalesce(a.n, 0) as n_left, coalesce(b.n, 0) as n_right, coalesce(ms, 0) as overlap_ms, coalesce(a.t, '') as left, coalesce(b.t, '') as right
from a full join b using (source_id, bucket) left join o using (source_id, bucket)""".replace(" as left, ", ' as "left", ').replace(" as right\n", ' as "right"\n')
)
def tracks_side_by_side(spark, sf_dir):
    return quality.side_by_side(*_tracks(spark, sf_dir))


@_query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as norm, round(list_sum(embedding::double[]) * 0.5 + 1, 6) as unit from embeddings")
def embedding_kernels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    n = e.select(F.max(F.size("embedding"))).first()[0] or 0
    unit = kernels.pointwise(F.col("embedding"), [[0.5] * n], [1.0])[0]
    return e.select("vec_id", F.round(kernels.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"), F.round(unit, 6).alias("unit"))


@_query("select source_id, case when max(end_ms) > 0 then round(sum(length(text) * length(role)) / 16.0 / (max(end_ms) / 1000.0), 3) end as rtf from " + UTTERANCES + " group by 1")
def real_time_factors(spark, sf_dir):
    """As if a sixteenth of a second went to each character, by the letters of the role."""
    u = utterances(spark, sf_dir).groupBy("source_id").agg((F.max("end_ms") / 1000.0).alias("audio"), (F.sum(F.length("text") * F.length("role")) / 16.0).alias("spent"))
    return u.select("source_id", kernels.real_time_factor(F.col("spent"), F.col("audio")).alias("rtf"))


# The vectors of a label, by number, are frames of four channels. The first twelve vectors of all hold the weights.
_FRAMES_OF_4 = """m as (select row_number() over (order by vec_id) - 1 as k, embedding::double[] as e from embeddings order by vec_id limit 12),
x as (select label, row_number() over (partition by label order by vec_id) - 1 as frame, embedding[1:4]::double[] as x from embeddings)"""


def _frames_of_4(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    x = e.select(F.col("label").alias("source_id"), place.cast("long").alias("frame"), F.slice("e", 1, 4).alias("x"))
    return x, recurrent.matrix(e.orderBy("vec_id").limit(12), "vec_id", "e")


@_query(
    f"""with {_FRAMES_OF_4}, w as (select k as c, e[15:19] as w, e[21] as b from m where k < 4),
t as (select x.label, x.frame, c, any_value(b) + sum(y.x[c + 1] * w[y.frame - x.frame + 3]) as v from x join x y on y.label = x.label and abs(y.frame - x.frame) <= 2, w group by 1, 2, 3)
select label, frame, c as channel, round(v, 6) + 0.0 as value from t"""
)
def depthwise_kernel(spark, sf_dir):
    x, m = _frames_of_4(spark, sf_dir)
    y = recurrent.depthwise(x, m[:4, 14:19], m[:4, 20]).select(F.col("source_id").alias("label"), "frame", F.posexplode("y").alias("channel", "value"))
    return y.select("label", "frame", F.col("channel").cast("long").alias("channel"), (F.round("value", 6) + 0.0).alias("value"))


_GATE = "e.g[{0}] + list_dot_product(w[{0}], x) + list_dot_product(r[{0}], h)"


@_query(
    f"""with recursive {_FRAMES_OF_4}, p as (select list(e[5:8] order by k) as w, list(e[9:11] order by k) as r, list(e[12] + e[13] order by k) as g from m),
s as (select label, -1::bigint as frame, [0.0, 0.0, 0.0]::double[] as h, [0.0, 0.0, 0.0]::double[] as c from (select distinct label from x)
  union all select label, frame, list_transform(range(1, 4), lambda n: 1 / (1 + exp(-z[3 + n])) * ((exp(2 * c1[n]) - 1) / (exp(2 * c1[n]) + 1))), c1
  from (select *, list_transform(range(1, 4), lambda n: c[n] / (1 + exp(-z[6 + n])) + 1 / (1 + exp(-z[n])) * ((exp(2 * z[9 + n]) - 1) / (exp(2 * z[9 + n]) + 1))) as c1
    from (select s.label, x.frame, h, c, list_transform(range(1, 13), lambda n: {_GATE.format('n').replace('e.g', 'p.g')}) as z from s join x on x.label = s.label and x.frame = s.frame + 1, p)))
select label, frame, i - 1 as unit, round(h[i], 6) + 0.0 as value from (select *, unnest([1, 2, 3]::bigint[]) as i from s where frame >= 0)"""
)
def memory_kernel(spark, sf_dir):
    x, m = _frames_of_4(spark, sf_dir)
    h = recurrent.lstm(x, m[:, 4:8], m[:, 8:11], np.concatenate([m[:, 11], m[:, 12]])).select(F.col("source_id").alias("label"), "frame", F.posexplode("h").alias("unit", "value"))
    return h.select("label", "frame", F.col("unit").cast("long").alias("unit"), (F.round("value", 6) + 0.0).alias("value"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
