"""The same in SQL, where SQL can say it."""

SQL = {
    "op8_perspectives": """
with turns as (
    select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text
    from conversations
), people as (
    select distinct conv_id, speaker as participant from turns where speaker <> 'system'
), seen as (
    select t.conv_id, participant, turn, speaker, text,
        case when speaker = participant then 'assistant' when speaker = 'system' then 'system' else 'user' end as role,
        case when speaker = participant then 'assistant' when speaker = 'system' then 'system'
            else 'user name=' || speaker end as head
    from turns t join people p on t.conv_id is not distinct from p.conv_id
), rendered as (
    select *, '<|im_start|>' || head || chr(10) || text || '<|im_end|>' || chr(10) as rendered,
        length('<|im_start|>' || head || chr(10)) as head_chars
    from seen
), placed as (
    select *, row_number() over w - 1 as position,
        coalesce(sum(length(rendered)) over (w rows between unbounded preceding and 1 preceding), 0)::bigint as start
    from rendered window w as (partition by conv_id, participant order by turn nulls first, speaker, text)
)
select conv_id, participant, position, turn, speaker, role, rendered,
    case when speaker = participant then start + head_chars else start + length(rendered) end as loss_start,
    start + length(rendered) as loss_end, start
from placed
""",
}
