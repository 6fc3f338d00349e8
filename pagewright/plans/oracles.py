"""DuckDB SQL of the structuring queries, over the driver's tables. Its patterns are spelled out here, apart from the operators'."""

from __future__ import annotations

from .fixtures import TABLES_SQL, lines_sql, spans_sql

_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE = f"[{_WHITE}]"
MARKS = rf"[{_WHITE}|:—–\-]"
MARKS_DIGITS = rf"[{_WHITE}|:—–\-\p{{Nd}}]"
NO_WORD = r"[^_\p{N}\p{L}]"
TABLE_N = rf"^{WHITE}*[Tt][Aa][Bb][Ll][Ee]{WHITE}+\p{{Nd}}+([.-]\p{{Nd}}+)?[.:]?{WHITE}*"
MONO = "fixed|consolas|mono|courier"
NO_HEADER = "^(table|figure|image|chart|graph|input|output|context|token|description)"


def sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def strip(x: str) -> str:
    return sub(sub(x, f"^{WHITE}+"), f"{WHITE}+$")


def normalize(x: str) -> str:
    return strip(sub(sub(f"lower({x})", rf"[^{_WHITE}_\p{{N}}\p{{L}}]", " "), f"{WHITE}+", " "))


def strip_digits(x: str) -> str:
    return strip(sub(sub(x, f"^{MARKS_DIGITS}+"), f"{MARKS_DIGITS}+$"))


def is_open(x: str) -> str:
    return f"({has(x, f'-{WHITE}*$')} or not {has(x, f'[?!.{chr(34)}]{WHITE}*$')})"


def no_caption(x: str) -> str:
    return f"case when {has(x, TABLE_N)} then {strip(sub(x, TABLE_N))} else {x} end"


HYPHEN, SENTENCE = f"-{WHITE}*$", f'[?!.\"]{WHITE}*$'
OPEN = is_open("text")

LINES = f"lines as ({lines_sql('duckdb')})"
SPANS = f"""spans as ({spans_sql('duckdb')}),
boxes as ({TABLES_SQL}),
kept as (select *, (flags & 16) <> 0 or contains(lower(font), 'bold') as is_bold, {has('lower(font)', MONO)} as is_mono from spans s
  where not exists (select 1 from boxes b where b.doc_id = s.doc_id and b.page = s.page and (s.x0 + s.x1) / 2 between b.x0 and b.x1 and (s.y0 + s.y1) / 2 between b.y0 and b.y1))"""
READ = f"""{SPANS},
down as (select *, row_number() over (partition by doc_id, page order by y0, seq) as rn from kept),
walk(doc_id, page, rn, anchor, line_no) as (select doc_id, page, rn, y0, 0 from down where rn = 1
  union all select d.doc_id, d.page, d.rn, case when abs(d.y0 - w.anchor) <= 3.0 then w.anchor else d.y0 end, case when abs(d.y0 - w.anchor) <= 3.0 then w.line_no else w.line_no + 1 end
  from walk w join down d on d.doc_id = w.doc_id and d.page = w.page and d.rn = w.rn + 1),
ordered as (select d.*, w.line_no from down d join walk w on w.doc_id = d.doc_id and w.page = d.page and w.rn = d.rn)"""
PARAS = f"""{READ},
stepped as (select *, case when y0 - lag(y0) over o > 1.5 * (font_size + lag(font_size) over o) / 2 then 1 else 0 end as far from ordered window o as (partition by doc_id, page order by line_no, x0, y0, seq)),
numbered as (select *, sum(far) over (partition by doc_id, page order by line_no, x0, y0, seq rows unbounded preceding) as para_no from stepped),
paras as (select doc_id, dense_rank() over (partition by doc_id order by page) - 1 as page_no, para_no, string_agg(text, ' ' order by line_no, x0, y0, seq) as text, count(*) as n_spans, max(font_size) as size,
  bool_or(is_bold) as bold, bool_or(is_mono) as mono, count(*) filter (where is_bold) as n_bold, first(y0 order by line_no, x0, y0, seq) as y_first, last(y0 order by line_no, x0, y0, seq) as y_last,
  first(font_size order by line_no, x0, y0, seq) as s_first,
  list({{'text': text, 'size': font_size, 'y': y0, 'bold': is_bold, 'mono': is_mono}} order by line_no, x0, y0, seq) as spans, last(font_size order by line_no, x0, y0, seq) as s_last, list(text order by line_no, x0, y0, seq) as texts from numbered group by doc_id, page, para_no)"""
BASE = """halves as (select doc_id, round_even(font_size * 2, 0) / 2 as half, count(*) as n, min(page * 1000000 + seq) as first from kept where font_size > 0 group by all),
base as (select doc_id, coalesce((select half from halves h where h.doc_id = d.doc_id order by n desc, first limit 1), 12.0) as baseline from (select distinct doc_id from kept) d)"""
LEVELS = f"""{PARAS}, {BASE},
seen as (select p.*, baseline, lag(y_last) over w as y_before, lag(s_last) over w as s_before, {strip('text')} as bare from paras p join base using (doc_id) window w as (partition by doc_id order by page_no, para_no)),
rated as (select *, case when baseline > 0 then size / baseline else 1.0 end as ratio, coalesce(y_first - y_before > 1.5 * (s_first + s_before) / 2, false) as spaced from seen),
levelled as (select *, case when bare = '' or {has('lower(bare)', NO_HEADER)} or {has('bare', '[()]')} or (n_bold >= 2 and n_bold < n_spans)
    or len(list_filter(regexp_split_to_array(bare, '{WHITE}+'), lambda x: x <> '')) > 15 then 0
  when y_before is not null and not spaced and ratio < 1.3 and not (bold and ratio >= 1.2) then 0
  when ratio >= 1.5 or (bold and ratio >= 1.3) then 1 when ratio >= 1.3 or (bold and ratio >= 1.15) then 2 when ratio >= 1.15 or bold then 3 else 0 end as level from rated)"""
FENCES = f"""marked as (select *, starts_with({strip('line')}, '```') as fence, {has('line', rf"^{WHITE}*#{{1,4}}{WHITE}+[^{_WHITE}]")} as header from lines),
fenced as (select *, not fence and coalesce(sum(fence::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) % 2 = 1 as code from marked)"""
FENCED = f"{LINES}, {FENCES}"
PIPE = f"""case when not contains(line, '|') or {strip('line')} = '' or starts_with({strip('line')}, '|') or (length(line) - length(replace(line, '|', '')) >= 2 and {has('line', rf"---|\|{WHITE}*-{{2,}}")}) then false
  when {has('line', rf"\|{WHITE}*\p{{Nd}}+(?:{NO_WORD}|\z)")} or {has('line', rf"\A{WHITE}*\p{{Nd}}+{WHITE}*\|")} then true
  else length({sub("split_part(line, '|', 1)", r"[^\p{L}]")}) >= 3 or length({sub("substr(line, strpos(line, '|') + 1)", r"[^\p{L}]")}) >= 3 end"""
RIGHT = strip("substr(line, strpos(line, '|') + 1)")
BODY = sub(sub(RIGHT, rf"\A{WHITE}*\p{{Nd}}+{WHITE}*"), rf"\A{MARKS}+")

# a title's own words, taken off in front, leave what is no word at its end
AFTER_TITLE = sub(strip(f"case when {has(RIGHT, chr(92) + 'A[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')} then regexp_extract({RIGHT}, '{NO_WORD}*{chr(92)}z') else {RIGHT} end"), rf"\A{MARKS}+")


def seen_before(title: str) -> str:
    return f"({title} <> '' and exists (select 1 from titles h where h.doc_id = f.doc_id and h.since < f.line_no and (h.title = {title} or (least(length(h.title), length({title})) >= 10 and (contains(h.title, {title}) or contains({title}, h.title))))))"


TITLES = f"titles as (select doc_id, {normalize(strip(sub('line', chr(92) + 'A#+')))} as title, min(line_no) as since from fenced where header and not fence and not code group by all having title <> '')"
SECTIONS = f"""{LINES},
bare as (select doc_id, line_no, {sub(strip('line'), r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]")} as line from lines),
coded as (select *, sum(starts_with(line, '```')::int) over (partition by doc_id order by line_no) % 2 = 1 as code from bare),
ranked as (select *, case when code then 0 when line = '###' or starts_with(line, '### ') then 3 when line = '##' or starts_with(line, '## ') then 2 when line = '#' or starts_with(line, '# ') then 1 else 0 end as level from coded),
placed as (select *, max(case when level = 1 then line_no end) over w as a1, max(case when level = 2 then line_no end) over w as a2, max(case when level = 3 then line_no end) over w as a3,
  sum(((level > 0) or (line = '' and not code))::int) over w as piece from ranked window w as (partition by doc_id order by line_no)),
titled as (select p.*, {strip('substr(x1.line, 2)')} as h1, case when a2 > coalesce(a1, -1) then {strip('substr(x2.line, 3)')} end as h2, case when a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) then {strip('substr(x3.line, 4)')} end as h3
  from placed p left join ranked x1 on x1.doc_id = p.doc_id and x1.line_no = a1 left join ranked x2 on x2.doc_id = p.doc_id and x2.line_no = a2 left join ranked x3 on x3.doc_id = p.doc_id and x3.line_no = a3
  where p.level = 0 and (p.line <> '' or p.code)),
changed as (select *, lag(line_no) over w is null or (h1, h2, h3) is distinct from (lag(h1) over w, lag(h2) over w, lag(h3) over w) as new, lag(piece) over w as piece_before from titled window w as (partition by doc_id order by line_no)),
counted as (select *, sum(new::int) over (partition by doc_id order by line_no) - 1 as section_no from changed),
sections as (select doc_id, cast(section_no as int) as section_no, h1, h2, h3, string_agg((case when new then '' when piece = piece_before then chr(10) else '  ' || chr(10) end) || line, '' order by line_no) as content from counted group by all)"""
WHOLE = f"{LINES}, texts as (select doc_id, string_agg(line, chr(10) order by line_no) as text from lines group by doc_id)"

# what follows "with lines as (...)," in the passes over Markdown lines
PIPE_PASS = f"""{FENCES}, {TITLES},
c as (select f.*, {normalize(strip_digits("split_part(line, '|', 1)"))} as left_title, {normalize(RIGHT)} as right_title, {BODY} as body, {AFTER_TITLE} as after, {has("split_part(line, '|', 1)", rf"{chr(92)}A{WHITE}*{chr(92)}p{{Nd}}+{WHITE}*{chr(92)}z")} as number_first,
  not fence and not code and not header and ({PIPE}) as asked from fenced f),
r as (select doc_id, line_no, line, asked, body, after, {seen_before('f.left_title')} as left_seen, number_first and {seen_before('f.right_title')} as right_seen from c f)
select doc_id, line_no, case when asked and left_seen then body when asked and right_seen then after else line end as line from r where not (asked and (left_seen and body = '' or not left_seen and right_seen and after = ''))"""
PAGE_PASS = f"""{FENCES},
n as (select *, regexp_extract(line, '\\A{WHITE}*(\\p{{Nd}}{{1,3}}){WHITE}+[A-Za-z]', 1) as number, coalesce(lag({strip('line')} = '') over (partition by doc_id, code order by line_no), true) as starts from fenced),
c as (select *, not fence and not code and not header and starts and number <> '' and not {has('number', r"\A0+\z")} as fits from n),
m as (select *, min(case when fits then line_no end) over (partition by doc_id) as first from c)
select doc_id, line_no, case when line_no = first then regexp_extract(line, '\\A({WHITE}*)', 1) || regexp_replace(line, '\\A{WHITE}*\\p{{Nd}}{{1,3}}{WHITE}+', '') else line end as line from m"""
NUMBER_PASS = f"{FENCES} select doc_id, line_no, line from fenced where fence or code or header or not {has('line', rf'{chr(92)}A{WHITE}*{chr(92)}p{{Nd}}{{1,2}}{WHITE}+[A-Za-z]')}"


def text_of(spans: str) -> str:
    return f"array_to_string(list_transform({spans}, lambda s: s.text), ' ')"


def first_text(spans: str, text: str) -> str:
    """The spans with the first one's text replaced."""
    return f"list_prepend({{{{'text': {text}, 'size': {spans}[1].size, 'y': {spans}[1].y, 'bold': {spans}[1].bold, 'mono': {spans}[1].mono}}}}, {spans}[2:])".replace("{{", "{").replace("}}", "}")


_BAR_NUMBER = rf"{WHITE}*\p{{Nd}}{{1,4}}{WHITE}*\|{WHITE}*(?:\p{{Nd}}+{WHITE}*)?{MARKS}*"
_TITLE = f"replace(k.header, ' ', '{NO_WORD}*')"
_NUMBER = rf"^\p{{Nd}}{{1,4}}$"
_LEFT, _RIGHT = strip("split_part(p.text, '|', 1)"), strip("substr(p.text, strpos(p.text, '|') + 1)")
RUNNING = f"""known as materialized (select distinct doc_id, {normalize('bare')} as header from levelled where level > 0 and not mono and {normalize('bare')} <> ''),
asked as materialized (select p.doc_id, p.page_no, p.para_no, p.text, case when {has(_LEFT, _NUMBER)} then {_RIGHT} when {has(_RIGHT, _NUMBER)} then {_LEFT} end as title from paras p
  where contains(p.text, '|') and not {has("regexp_extract(p.text, '[A-Za-z]')", '[a-z]')} and p.doc_id in (select doc_id from known)),
met as (select a.*, k.header, regexp_extract(a.text, '(?i)^({_BAR_NUMBER}' || {_TITLE} || '{MARKS}*)', 1) as met, regexp_matches(a.text, '(?i)^' || {_TITLE} || '{MARKS}*{WHITE}*\\|{WHITE}*\\p{{Nd}}{{1,4}}{WHITE}*$') as ends_so from asked a join known k on k.doc_id = a.doc_id and contains(lower(a.text), split_part(k.header, ' ', 1))),
cuts as (select *, case when met <> '' and starts_with({normalize(strip_digits('met'))}, header) then {sub(strip('substr(text, length(met) + 1)'), f'^{MARKS}+')} when ends_so then '' end as cut from met),
chosen as (select * from cuts where cut is not null qualify row_number() over (partition by doc_id, page_no, para_no order by length(header) desc, header) = 1),
weighed as (select p.doc_id, p.page_no, p.para_no, p.text, p.spans, c.cut, row_number() over (partition by p.doc_id, p.page_no order by p.para_no) = 1 and a.text is not null
    and not exists (select 1 from known k where k.doc_id = p.doc_id and k.header = {normalize(strip_digits('a.title'))}) as waits,
  case when c.cut is null then p.spans else {first_text('p.spans', 'c.cut')} end as cut_spans
  from paras p left join asked a on a.doc_id = p.doc_id and a.page_no = p.page_no and a.para_no = p.para_no left join chosen c on c.doc_id = p.doc_id and c.page_no = p.page_no and c.para_no = p.para_no),
judged as materialized (select *, case when cut is null or cut <> '' then {is_open(text_of('cut_spans'))} end as after_cut, case when waits then {is_open('text')} when cut is null or cut <> '' then {is_open(text_of('cut_spans'))} end as uncut from weighed),
ends as materialized (select doc_id, page_no, coalesce(arg_max(after_cut, para_no) filter (where after_cut is not null), false) as closed, coalesce(arg_max(uncut, para_no) filter (where uncut is not null), false) as open from judged group by all),
follow(doc_id, page_no, follows, now) as (select doc_id, page_no, false, closed from ends where page_no = 0
  union all select e.doc_id, e.page_no, f.now, case when f.now then e.open else e.closed end from follow f join ends e on e.doc_id = f.doc_id and e.page_no = f.page_no + 1),
cleaned as materialized (select j.doc_id, j.page_no, j.para_no, case when follows and waits then spans else cut_spans end as spans from judged j join follow f on f.doc_id = j.doc_id and f.page_no = j.page_no
  where (follows and waits) or cut is null or cut <> '')"""
CAPTIONS = f"""captioned as (select *, {text_of('spans')} as text, {no_caption(text_of('spans'))} as rest from cleaned),
uncaptioned as materialized (select doc_id, page_no, para_no, case when rest = text then spans else {first_text('spans', 'rest')} end as spans from captioned where not (rest = '' and text <> ''))"""


def joined_pages(of: str) -> str:
    """The paragraphs of a table joined over pages, as whole_paras."""
    last, first = "s.spans[-1]", "s.next[1]"
    fused = f"{{'text': {sub(f'{last}.text', f'{WHITE}*-{WHITE}*$')} || {sub(f'{first}.text', f'^{WHITE}+')}, 'size': {last}.size, 'y': {last}.y, 'bold': {last}.bold, 'mono': {last}.mono}}"
    return f"""page_ends as (select doc_id, page_no, count(*) as n, arg_max({is_open(text_of('spans'))}, para_no) as open from {of} group by all),
page_steps as materialized (select *, open and coalesce(lead(page_no) over w = page_no + 1, false) as able, row_number() over w as nth from page_ends window w as (partition by doc_id order by page_no)),
page_joins(doc_id, page_no, nth, joins) as (select doc_id, page_no, nth, able from page_steps where nth = 1
  union all select a.doc_id, a.page_no, a.nth, a.able and not (a.n = 1 and j.joins) from page_joins j join page_steps a on a.doc_id = j.doc_id and a.nth = j.nth + 1),
backward as (select p.*, coalesce(j.joins, false) and row_number() over (partition by p.doc_id, p.page_no order by p.para_no) = 1 as back from {of} p left join page_joins j on j.doc_id = p.doc_id and j.page_no = p.page_no - 1),
sided as (select *, case when lead(back) over w then lead(spans) over w end as next from backward window w as (partition by doc_id order by page_no, para_no)),
whole_paras as materialized (select doc_id, page_no, para_no, case when next is null then spans when {has('s.spans[-1].text', HYPHEN)} then list_concat(list_append(list_slice(spans, 1, len(spans) - 1), {fused}), next[2:]) else list_concat(spans, next) end as spans
  from sided s where not back)"""


FINAL = f"""measured as (select doc_id, page_no, para_no, {text_of('spans')} as text, len(spans) as n_spans, list_max(list_transform(spans, lambda s: s.size)) as size, len(list_filter(spans, lambda s: s.bold)) as n_bold,
  len(list_filter(spans, lambda s: s.mono)) > 0 as mono, spans[1].y as y_first, spans[1].size as s_first, spans[-1].y as y_last, spans[-1].size as s_last from whole_paras where {strip(text_of('spans'))} <> ''),
measured_ as (select *, n_bold > 0 as bold from measured)"""
FINAL_LEVELS = LEVELS[LEVELS.index("seen as (select p.*"):].replace("from paras p", "from measured_ p").replace("seen as", "seen_ as").replace("from seen)", "from seen_)").replace("rated as", "rated_ as").replace("from rated)", "from rated_)").replace("levelled as", "levelled_ as materialized")
EMIT = f"""grouped as (select *, sum((not (mono and coalesce(before, false)))::int) over (partition by doc_id order by page_no, para_no) as part from (select *, lag(mono) over (partition by doc_id order by page_no, para_no) as before from @)),
parts as (select doc_id, part, case when mono then (case when part > 1 then chr(10) || chr(10) else '' end) || '```' || chr(10) || string_agg(text, chr(10) order by page_no, para_no) || chr(10) || '```'
  else string_agg(case when level > 0 then repeat('#', level) || ' ' || bare else bare end, chr(10) order by page_no, para_no) end as part_text from grouped group by doc_id, part, mono),
emitted as (select doc_id, string_agg(part_text, chr(10) || chr(10) order by part) as markdown from parts group by doc_id)"""
CHAIN = f"""{LEVELS}, {RUNNING}, {CAPTIONS}, {joined_pages('uncaptioned')}, {FINAL}, {FINAL_LEVELS}, {EMIT.replace('@', 'levelled_')},
raw_lines as materialized (select doc_id, cast(i as bigint) as line_no, string_split(markdown, chr(10))[i + 1] as line from (select doc_id, markdown, unnest(range(len(string_split(markdown, chr(10))))) as i from emitted)),
no_pipes as materialized (with lines as (select * from raw_lines), {PIPE_PASS}),
no_numbers as materialized (with lines as (select * from no_pipes), {PAGE_PASS}),
clean_lines as materialized (with lines as (select * from no_numbers), {NUMBER_PASS}),
clean_texts as (select doc_id, string_agg(line, chr(10) order by line_no) as markdown from clean_lines group by doc_id)"""

def _cut(level: int, separator: str | None, size: int) -> str:
    """The pieces of what is too long at a level: (doc_id, section_no, path, i, piece, longs); longs counts the too long ones before."""
    parts = "range(length(piece))" if separator is None else f"range(len(string_split(piece, {separator})))"
    piece = "substr(piece, i + 1, 1)" if separator is None else f"(case when i > 0 then {separator} else '' end) || string_split(piece, {separator})[i + 1]"
    return f"""cut{level} as materialized (select *, coalesce(sum((length(piece) >= {size})::int) over (partition by doc_id, section_no, path order by i rows between unbounded preceding and 1 preceding), 0) as longs
  from (select doc_id, section_no, path, i, {piece} as piece from (select *, unnest({parts}) as i from long{level})) where piece <> ''),
long{level + 1} as (select doc_id, section_no, list_append(path, i) as path, piece from cut{level} where length(piece) >= {size})"""


def split(size: int, overlap: int, least: int) -> str:
    """Sections to chunks. Pieces under the chunk size that follow each other are a group. A chunk takes as many of a group as fit; the next begins with the earliest
    piece from which on no more than the overlap is taken over and its own first new piece still fits. ends: characters of the group up to each piece.
    """
    cuts = ", ".join(_cut(n, separator, size) for n, separator in enumerate(("chr(10) || chr(10)", "chr(10)", "' '", None), 1))
    return f"""{SECTIONS},
guarded as materialized (select *, regexp_extract_all(content, '```[\\s\\S]*?```') as blocks, regexp_split_to_array(content, '```[\\s\\S]*?```') as outside from sections),
long1 as (select doc_id, section_no, cast([] as bigint[]) as path, array_to_string(list_transform(range(len(outside)), lambda i: outside[i + 1] || case when i < len(blocks) then 'CODE_BLOCK_PLACEHOLDER_' || i else '' end), '') as piece from guarded where content <> ''),
{cuts},
short as (select *, sum(length(piece)) over (partition by doc_id, section_no, path, longs order by i) as upto from ({" union all ".join(f"select * from cut{n} where length(piece) < {size}" for n in (1, 2, 3, 4))})),
groups as materialized (select doc_id, section_no, list_append(path, min(i)) as place, list(piece order by i) as pieces, list(upto order by i) as ends from short group by doc_id, section_no, path, longs),
walk_(doc_id, section_no, place, first, last) as (select doc_id, section_no, place, 1, len(list_filter(ends, lambda e: e <= {size})) from groups
  union all select doc_id, section_no, place, begin, len(list_filter(ends, lambda e: e <= {size} + case when begin > 1 then ends[begin - 1] else 0 end))
  from (select *, 1 + (least_ > 0)::int + len(list_filter(ends, lambda e: e < least_)) as begin
    from (select w.*, g.ends, greatest(g.ends[w.last] - {overlap}, g.ends[w.last + 1] - {size}) as least_ from walk_ w join groups g on g.doc_id = w.doc_id and g.section_no = w.section_no and g.place = w.place where w.last < len(g.ends)))),
windows as (select w.doc_id, w.section_no, w.place, w.first, {strip("array_to_string(g.pieces[w.first:w.last], '')")} as content from walk_ w join groups g on g.doc_id = w.doc_id and g.section_no = w.section_no and g.place = w.place),
restored as (select w.*, s.h1, s.h2, s.h3, {strip("list_reduce(list_prepend(w.content, s.blocks), lambda text, block, i: replace(text, 'CODE_BLOCK_PLACEHOLDER_' || (i - 2), block))")} as whole
  from windows w join guarded s on s.doc_id = w.doc_id and s.section_no = w.section_no where w.content <> ''),
chunks as materialized (select doc_id, cast(row_number() over (partition by doc_id order by section_no, place, first) - 1 as int) as chunk_index, whole as content, h1, h2, h3 from restored where length(whole) >= {least})"""


SPLIT = split(1000, 150, 100)
RESOLVED = """t as (select conv_id as note_id, row_number() over (partition by conv_id order by turn) - 1 as card_no, concat(conv_id, case when turn % 5 = 4 then ':' else '::' end, turn) as id,
  case role when 'user' then 'qa' when 'assistant' then 'cloze' else role end as type, text as back, string_split(text, ' ')[1] as word, concat('turn-', turn % 3) as source_path, turn from conversations),
c as (select *, case when type = 'cloze' and card_no % 4 = 1 then '{{c1::' || word || '}}' else word end as front,
  [case when turn % 2 = 0 then 'chat' else 'other' end, 'of-' || type, 'turn-' || (card_no % 3)] as tags from t),
judged as (select *, array_to_string(list_filter([case when coalesce(trim(front), '') = '' then 'front' end, case when coalesce(trim(back), '') = '' then 'back' end, case when not coalesce(type in ('qa', 'cloze'), false) then 'type' end,
  case when type = 'cloze' and not contains(coalesce(front, ''), '{{c1::') then 'cloze' end, case when source_path not in ('turn-0', 'turn-1') then 'source_path' end], lambda x: x is not null), ',') as reasons from c),
placed as (select *, lower(trim(front)) as key, row_number() over (partition by note_id, lower(trim(front)) order by card_no) as place from judged where reasons = ''),
u as (select note_id, key, tag, min(card_no * 10 + pos) as met from (select note_id, key, card_no, unnest(tags) as tag, unnest([1, 2, 3]) as pos from placed) where tag <> 'chat' group by all),
good as (select placed.*, list_concat(['chat'], own) as list_distinct_in_order from placed left join (select note_id, key, list(tag order by met) as own from u group by all) g using (note_id, key))"""

ORACLES = {
    "spans_fixture": spans_sql("duckdb"),
    "md_fixture": lines_sql("duckdb"),
    "normalize_text": f"with {LINES} select doc_id, line_no, {normalize('line')} as normalized from lines",
    "strip_digits_seps": f"with {LINES} select doc_id, line_no, {strip_digits('line')} as stripped from lines",
    "sentence_end": f"with {SPANS} select doc_id, page, seq, {has('text', HYPHEN)} as hyphen, {has('text', SENTENCE)} as sentence from spans",
    "pipe_candidate": f"with {LINES} select doc_id, line_no, {PIPE} as candidate from lines",
    "table_caption": f"with {SPANS} select doc_id, page, seq, case when {has('text', TABLE_N)} then {strip(sub('text', TABLE_N))} else text end as stripped from spans",
    "font_flags": f"with {SPANS} select doc_id, page, seq, (flags & 16) <> 0 or contains(lower(font), 'bold') as is_bold, {has('lower(font)', MONO)} as is_mono from spans",
    "flatten_blocks": f"with {SPANS} select doc_id, page, {strip('text')} as text, font, font_size, x0, y0, x1, y1, flags from spans where {strip('text')} <> ''",
    "table_antijoin": f"with {SPANS} select doc_id, page, seq, text from kept",
    "baseline_font": f"with {SPANS}, {BASE} select doc_id, cast(baseline as double) as baseline from base",
    "reading_order": f"with recursive {READ} select doc_id, page, seq, cast(line_no as int) as line_no from ordered",
    "paragraphs": f"with recursive {PARAS} select doc_id, cast(page_no as int) as page_no, cast(para_no as int) as para_no, text, n_spans from paras",
    "classify_headers": f"with recursive {LEVELS} select doc_id, cast(page_no as int) as page_no, cast(para_no as int) as para_no, bare as text, mono as is_mono, cast(level as int) as level from levelled",
    "known_headers": f"with recursive {LEVELS} select distinct doc_id, {normalize('bare')} as header from levelled where level > 0 and not mono and {normalize('bare')} <> ''",
    "drop_captions": f"""with recursive {PARAS}, c as (select *, case when {has('text', TABLE_N)} then {strip(sub('text', TABLE_N))} else text end as rest from paras)
select doc_id, cast(page_no as int) as page_no, cast(para_no as int) as para_no, case when rest = text then text else array_to_string(list_prepend(rest, texts[2:]), ' ') end as text from c where not (rest = '' and text <> '')""",
    "page_merge": f"""with recursive {PARAS},
pages as (select doc_id, page_no, count(*) as n, last({OPEN} order by para_no) as open from paras group by all),
able as (select *, open and coalesce(lead(page_no) over (partition by doc_id order by page_no) = page_no + 1, false) as able from pages),
joined(doc_id, page_no, joins) as (select doc_id, page_no, able from able where page_no = 0
  union all select a.doc_id, a.page_no, a.able and not (a.n = 1 and j.joins) from joined j join able a on a.doc_id = j.doc_id and a.page_no = j.page_no + 1)
select doc_id, cast(page_no as int) as page_no, joins from joined""",
    "markdown": f"""with recursive {LEVELS},
filled as (select * from levelled where bare <> ''),
grouped as (select *, sum((not (mono and coalesce(before, false)))::int) over (partition by doc_id order by page_no, para_no) as part from (select *, lag(mono) over (partition by doc_id order by page_no, para_no) as before from filled)),
parts as (select doc_id, part, case when mono then (case when part > 1 then chr(10) || chr(10) else '' end) || '```' || chr(10) || string_agg(text, chr(10) order by page_no, para_no) || chr(10) || '```'
  else string_agg(case when level > 0 then repeat('#', level) || ' ' || bare else bare end, chr(10) order by page_no, para_no) end as part_text from grouped group by doc_id, part, mono)
select doc_id, string_agg(part_text, chr(10) || chr(10) order by part) as markdown from parts group by doc_id""",
    "pipe_lines": f"with {LINES}, {PIPE_PASS}",
    "page_number_prefix": f"with {LINES}, {PAGE_PASS}",
    "numbered_drop": f"with {LINES}, {NUMBER_PASS}",
    "md_sections": f"with {SECTIONS} select * from sections",
    "section_names": f"with {SECTIONS} select doc_id, cast(row_number() over (partition by doc_id order by section_no) - 1 as int) as chunk_index, coalesce(h1, h2, h3, '') as section_name, cast(length({strip('content')}) as bigint) as n_chars from sections where length({strip('content')}) >= 100",
    "code_blocks": rf"with {WHOLE} select doc_id, unnest(range(len(b))) as block_no, unnest(b) as block from (select doc_id, regexp_extract_all(text, '```[\s\S]*?```') as b from texts)",
    "char_count": "select doc_id, cast(length(text) as bigint) as n_chars from documents",
    "card_validate": """with c as (select conv_id as note_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as card_no, concat(conv_id, case when turn % 5 = 4 then ':' else '::' end, turn) as id, case role when 'user' then 'qa' when 'assistant' then 'cloze' else role end as type, text as front, concat('turn-', turn % 3) as source_path, case when turn % 2 = 0 then ['chat'] else ['other'] end as tags from conversations)
select note_id, card_no, starts_with(id, concat(note_id, '::')) as id_ok, count(*) over (partition by note_id, id) = 1 as "unique", coalesce(type in ('qa', 'cloze'), false) as type_ok, coalesce(type <> 'cloze' or contains(front, '{{c1::'), false) as cloze_ok,
  source_path in ('turn-0', 'turn-1') as path_ok, list_contains(tags, 'chat') as tags_ok, row_number() over (partition by note_id, lower(trim(front)) order by card_no) = 1 as first_of_kind from c""",
    "running_headers": f"with recursive {LEVELS}, {RUNNING} select doc_id, cast(page_no as int) as page_no, cast(para_no as int) as para_no, {text_of('spans')} as text from cleaned",
    "join_pages": f"with recursive {PARAS}, {joined_pages('paras')} select doc_id, cast(page_no as int) as page_no, cast(para_no as int) as para_no, {text_of('spans')} as text from whole_paras",
    "full_markdown": f"with recursive {CHAIN} select doc_id, markdown from clean_texts",
    "document_summary": f"""with recursive {CHAIN}
select doc_id, n_headers, n_paragraphs, cast(length(markdown) as bigint) as n_chars, sha256(markdown) as markdown_sha from clean_texts join (select doc_id, count(*) filter (where level > 0) as n_headers, count(*) as n_paragraphs from levelled_ group by doc_id) using (doc_id)""",
    "note_json": """select doc_id as note_id, to_json(struct_pack(note_id := doc_id::varchar, title := source, frontmatter := struct_pack(tags := [lang]), chunks := [struct_pack(path := source, content := text)]))::varchar as json from documents""",
    "render_prompt": """select doc_id as note_id, concat('Cards for this note:', chr(10), substr(q, 2, length(q) - 2), chr(10), 'Answer with JSON.') as prompt
from (select doc_id, to_json((to_json(struct_pack(note_id := doc_id::varchar, title := source, frontmatter := struct_pack(tags := [lang]), chunks := [struct_pack(path := source, content := text)]))::varchar))::varchar as q from documents)""",
    "parse_cards": """select conv_id as note_id, cast(row_number() over (partition by conv_id order by turn, text, role) - 1 as int) as card_no, concat(conv_id, '::', turn) as id, 'qa' as type, text as front, role as back, cast(null as varchar) as source_path, role as tag
from conversations""",
    "chunks": f"""with recursive {SPLIT}
select doc_id, chunk_index, content, '' as book_title, '' as chapter_name, coalesce(h1, h2, h3, '') as section_name,
  map_from_entries(list_filter([{{'k': 'Header 1', 'v': h1}}, {{'k': 'Header 2', 'v': h2}}, {{'k': 'Header 3', 'v': h3}}], lambda x: x.v is not null))::json::varchar as metadata from chunks""",
    "chunks_titled": f"""with recursive {split(600, 80, 40)},
in_chapters as (select *, case when doc_id % 12 = 0 then '' else 'Chapter ' || (doc_id % 12) end as chapter from chunks)
select doc_id, chunk_index, content, 'Collected notes' as book_title, coalesce(chapter, '') as chapter_name, coalesce(h1, h2, h3, '') as section_name, map_from_entries(list_filter([{{'k': 'Header 1', 'v': h1}}, {{'k': 'Header 2', 'v': h2}},
  {{'k': 'Header 3', 'v': h3}}, {{'k': 'book_title', 'v': 'Collected notes'}}, {{'k': 'chapter_name', 'v': nullif(chapter, '')}}], lambda x: x.v is not null))::json::varchar as metadata from in_chapters""",
    "chunk_stats": f"with recursive {SPLIT} select doc_id, count(*) as n_chunks, cast(sum(length(content)) as bigint) as n_chars, cast(max(length(content)) as int) as longest, cast(min(length(content)) as int) as shortest from chunks group by doc_id",
    "related_exact": """with v as (select vec_id, embedding::double[] as e from embeddings),
p as (select a.vec_id, b.vec_id as neighbor, round(list_cosine_similarity(a.e, b.e), 9) as similarity from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id)
select * from (select vec_id, row_number() over (partition by vec_id order by similarity desc, neighbor) as rank, neighbor, similarity from p) where rank <= 10""",
    "card_schedule": """with recursive r as (select user_id, event_type, ts, greatest(0, least(5, floor(value / 10)::int)) as q, row_number() over (partition by user_id, event_type order by ts, floor(value / 10)) as i from events where ts is not null and value is not null),
s as (select user_id, event_type, 0::bigint as i, 0::bigint as streak, 250::bigint as ease, 0::bigint as days, null::timestamp as ts from r where r.i = 1
  union all select r.user_id, r.event_type, r.i, case when q < 3 then 0 else streak + 1 end, greatest(130, ease + 10 - (5 - q) * (8 + 2 * (5 - q))),
  case when q < 3 or streak = 0 then 1 when streak = 1 then 6 else least(36500, (days * ease + 99) // 100) end, r.ts from s join r on r.user_id is not distinct from s.user_id and r.event_type is not distinct from s.event_type and r.i = s.i + 1)
select user_id, event_type, i as n_reviews, streak as repetitions, ease / 100 as ease, days as interval_days, (ts::date + days::int)::varchar as due from (select *, max(i) over (partition by user_id, event_type) as n from s) where i = n""",
    "note_changes": """with a as (select doc_id, sha256(text) as old from documents where contains(text, chr(10))),
b as (select doc_id, text || case when n_chars % 2 = 0 then chr(10) || 'reviewed' else '' end as content from documents where length(text) < 2000)
select coalesce(a.doc_id, b.doc_id) as doc_id, case when content is null then 'delete' when old is null then 'insert' else 'update' end as change, coalesce(length(content), 0) as n_chars, sha256(content) as digest
from a full join b on a.doc_id = b.doc_id where old is distinct from sha256(content)""",
    "card_accepted": f"""with {RESOLVED}
select note_id, row_number() over (partition by note_id order by card_no) - 1 as index, concat(note_id, '::', row_number() over (partition by note_id order by card_no) - 1) as id, type, front, back, source_path,
  array_to_string(list_distinct_in_order, ',') as tags from good where place = 1""",
    "card_rejected": f"""with {RESOLVED}
select note_id, card_no, id, reasons from judged where reasons <> '' union all select note_id, card_no, id, 'duplicate' from good where place > 1""",
}
