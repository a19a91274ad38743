"""SQL of the queries that SQL can express over whole tables. Splitting, encoding, mixing, phrase repair and page
scoring have none; they are tested against brute force, round trips and the tokenizer itself."""

from __future__ import annotations

from quillstream.plans.timeline import OFFSET_SQL, SLIDE_SQL

_NEAR = f"""h as (select distinct entry_id, video_id, round(({OFFSET_SQL}) * 1000000)::bigint us from html_data where video_id is not null),
  i as (select distinct slide_id, video_id, round(({SLIDE_SQL}) * 1000000)::bigint us from img),
  m as (select h.entry_id, h.video_id, i.slide_id, row_number() over (partition by h.entry_id, h.video_id, h.us order by abs(i.us - h.us), i.slide_id) rn
        from h left join i on i.video_id = h.video_id and abs(i.us - h.us) < 5000000 where h.us is not null and entry_id is not null)"""

SQL = {
    # Every pair of units, by the words they share.
    "p1_found": r"""with w as (select distinct unit_id, lower(concat_ws(' ', summary, verbatim_anchor)) t from knowledge_units where unit_id is not null),
  s as (select unit_id, list_distinct(list_filter(regexp_split_to_array(t, '[^\p{L}\p{N}\p{M}]+'), lambda x: x <> '')) ws from w),
  e as (select unit_id, unnest(ws) word from s), n as (select unit_id, len(ws) k from s),
  i as (select a.unit_id x, b.unit_id y, count(*) c from e a join e b on a.word = b.word and a.unit_id < b.unit_id group by 1, 2)
  select x unit_id_a, y unit_id_b from i join n p on p.unit_id = x join n q on q.unit_id = y where c >= 0.6 * (p.k + q.k - c)""",
    # What each image reaches, until nothing new is reached.
    "p2_found": r"""with recursive l as (select lower(regexp_replace(image1, '^\s+|\s+$', '', 'g')) a, lower(regexp_replace(image2, '^\s+|\s+$', '', 'g')) b
    from duplicates where is_duplicate and image1 is not null and image2 is not null),
  e as (select a, b from l where a <> b and a <> '' and b <> '' union select b, a from l where a <> b and a <> '' and b <> ''),
  r as (select a node, a reach from e union select r.node, e.b from r join e on e.a = r.reach)
  select min(reach) group_image, node image from r group by node""",
    "p4_found": f"with {_NEAR} select entry_id, slide_id from m where rn = 1 and slide_id is not null",
    "p4_unmatched": f"with {_NEAR} select entry_id, video_id from m where rn = 1 and slide_id is null",
    "p5_found": "select distinct file_id from transcript_files join pipeline_config using (profile) where length(content) > max_segment_chars and max_segment_chars > 0",
    # Encoded and decoded again, a text is itself.
    "p6_decoded": "select doc_id, coalesce(text, '') as \"text\" from documents",
}
