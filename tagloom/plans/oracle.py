"""SQL that gives the same rows as the core's queries, where SQL can."""

from __future__ import annotations

import re

from tagloom.operators import quantity

_NEAR = """with n as (select distinct idx, lat / 1e7 as lat, lon / 1e7 as lon from node where lat is not null and lon is not null),
c as (select *, cast(floor(lat / 0.0005) as bigint) as y from n),
p as (select a.idx as ia, b.idx as ib, a.lat as lat1, a.lon as lon1, b.lat as lat2, b.lon as lon2
  from c a join (select c.*, y + d as yy from c, (values (-1), (0), (1)) v(d)) b on a.y = b.yy
  and (abs(a.lon - b.lon) * cos(radians(a.lat)) < 0.0005 or abs(a.lon - b.lon) > 359) and a.idx < b.idx),
m as (select ia, ib, 2 * 6372797.560856e0 * asin(least(1e0, sqrt(power(sin(radians(lat2 - lat1) / 2), 2)
  + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2)))) as metres from p)
select ia as idx_a, ib as idx_b, round(min(metres), 3) as metres from m where metres <= 25 group by ia, ib"""

_LINKS = """l as (select distinct r.idx as child, m.idx as parent from rel_member m
  join (select distinct idx, osm_id from rel) r on r.osm_id = m.ref_osm_id where m.mtype = 'relation'),
down as (select distinct parent as node, parent as root, 0 as depth, cast(parent as varchar) as path from l
  where parent not in (select child from l)
  union all select l.child, d.root, d.depth + 1, d.path || '/' || l.child from down d join l on l.parent = d.node)"""

_PATHS = f"""with recursive {_LINKS}
select node as idx, root as root_idx, cast(depth as bigint) as depth, path from down
union all select child, -1, -1, null from l where child not in (select node from down)
union all select distinct idx, idx, 0, cast(idx as varchar) from rel
where idx not in (select child from l union all select parent from l)"""

#: Typed columns of attr_type, fixed in the test data.
_TYPED = {
    "int": ["building:levels", "capacity", "lanes", "layer", "admin_level"],
    "double": ["incline", "min_height"],
    "boolean": ["oneway", "lit", "outdoor_seating"],
    "date": ["start_date", "check_date"],
    "text": ["name", "operator", "ref", "surface"],
}
_FITS = {
    "int": "regexp_full_match(w, '[+-]?[0-9]{1,18}')",
    "double": "regexp_full_match(w, '[+-]?[0-9]+([.][0-9]+)?')",
    "boolean": "lower(w) in ('yes', 'no', 'true', 'false', '1', '0')",
    "date": "(regexp_full_match(w, '[0-9]{4}-[0-9]{2}-[0-9]{2}') and try_cast(w as date) is not null)",
}
_CASTS = {"int": "cast(w as bigint)", "double": "cast(w as double)", "boolean": "lower(w) in ('yes', 'true', '1')", "date": "cast(w as date)", "text": "v"}

_TAGS = """t as (select distinct 'node' as kind, idx, pos, k, v from node_tag
  union all select distinct 'way', idx, pos, k, v from way_tag
  union all select distinct 'relation', idx, pos, k, v from rel_tag)"""

_FIRST = f"""{_TAGS},
f as (select kind, idx, k, arg_min(v, pos) as v, trim(arg_min(v, pos), ' ') as w, count(distinct v) as n from t where k is not null and v is not null group by kind, idx, k)"""


def _typed_columns() -> str:
    return ", ".join(
        f"max(case when k = '{k}' and {_FITS.get(kind, 'true')} then {_CASTS[kind]} end) as {k.replace(':', '_')}" for kind, keys in _TYPED.items() for k in keys
    )


def _unfit() -> str:
    return " or ".join(f"(col_type = '{kind}' and not {fits})" for kind, fits in _FITS.items())


_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NUM = "[+-]?([0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?|[0-9]{1,3}(''[0-9]{3})+|[0-9]{1,3}( [0-9]{3})+|[0-9]+([.,][0-9]+)?)"
_NAMES = {"population": quantity.PEOPLE_NAMES, "ele": quantity.LENGTH_NAMES, "height": quantity.LENGTH_NAMES, "maxspeed": quantity.SPEED_NAMES}


def _named() -> str:
    """SQL: the unit that text t of key k names beside one number; NULL if it names none."""
    counted = "((" + "|".join([*quantity.WORDS, "half", "hundred"]) + ")[ -]+)+"
    cases = []
    for key in _NAMES:
        for unit, spelt in _NAMES[key].items():
            names = "|".join(re.sub(r"([.])", r"[\1]", x).replace("'", "''") for x in sorted(spelt, key=len, reverse=True))
            names = f"({names})"
            if key == "population":
                names = f"{names}([.]* ({'|'.join(quantity.PEOPLE_NAMES['person'])}))?"
            cases.append(f"when k = '{key}' and regexp_full_match(t, '{_NUM} ?-? ?{names}[.]*|{names}[.]? ?{_NUM}|{counted}{names}[.]*') then '{unit}'")
    feet, inches = "(ft[.]?|feet|foot|''|′|’)", "(in[.]?|inch|inches|\"|″|”|'''')"
    cases.append(f"when k in ('ele', 'height') and regexp_full_match(t, '[0-9]+ ?-? ?{feet} ?-? ?[0-9]+([.,][0-9]+)? ?-? ?{inches}') then 'ft'")
    return f"case {' '.join(cases)} end"


_QUANTITIES = f"""with q as (select distinct idx, pos, k, v from node_tag where k in ('population', 'ele', 'height', 'maxspeed') and v is not null),
q2 as (select idx, pos, k, regexp_replace(trim(lower(regexp_replace(v, '{_SPACE}', ' ', 'g')), ' '),
  '^((ca|circa|about|approx|approximately|around|etwa|rund|environ|unos|over|some|c)([.] *| +)|[~≈] *)', '') as t from q),
src as (select idx, arg_min(v, (pos, v)) as source from (select distinct idx, pos, v from node_tag where k = 'source' and v is not null) group by idx),
named as (select q2.*, source, {_named()} as unit, regexp_full_match(t, '{_NUM} ?-? ?') as bare from q2 left join src on src.idx = q2.idx),
decl as (select source_name, k, min(unit) as unit from source_unit group by all)"""

SQL: dict[str, str] = {
    "p4_found": f"""{_QUANTITIES}, r as (select n.idx, n.pos, n.k, coalesce(n.unit, case when bare then d.unit end) as unit from named n left join decl d on d.source_name = source and d.k = n.k)
      select idx, pos, unit from r where unit is not null and (k, unit) not in (('population', 'person'), ('ele', 'm'), ('height', 'm'), ('maxspeed', 'km/h'))""",
    # the graph has to find exactly what was declared
    "p4_withheld": f"""{_QUANTITIES}, c as (select k, source, count(*) as n from named where bare and unit is null and regexp_matches(t, '[1-9]') and not starts_with(t, '-') group by 1, 2)
      select c.k, source, d.unit as declared, d.unit as estimated from c join decl d on d.source_name = source and d.k = c.k where n >= 20""",
    "p6_typed": f"with {_FIRST} select t.kind, t.idx, {_typed_columns()} from (select distinct kind, idx from t) t left join f on f.kind = t.kind and f.idx = t.idx group by t.kind, t.idx",
    "p6_texts": f"with {_FIRST} select kind, idx, f.k, f.v from f left join attr_type a on a.k = f.k where coalesce(col_type, 'text') = 'text'",
    "p6_found": f"""with {_FIRST} select kind, idx, k, 'conflict' as issue from f where n > 1
      union all select kind, idx, f.k, 'unfit' from f join attr_type a on a.k = f.k where {_unfit()}""",
    "p5_found": f"select idx, root_idx, depth from ({_PATHS}) where depth <> 0",
    "p5_paths": _PATHS,
    "p5_descendants": f"""with recursive {_LINKS},
      under as (select parent as ancestor, child as descendant, 1 as steps from l where child in (select node from down)
        union all select u.ancestor, l.child, u.steps + 1 from under u join l on l.parent = u.descendant)
      select ancestor, descendant, cast(steps as bigint) as steps from under""",
    "p5_circle_descendants": f"""with recursive {_LINKS},
      up as (select child as descendant, parent as ancestor, 1 as steps, [parent] as trail from l where child not in (select node from down)
        union all select u.descendant, l.parent, u.steps + 1, list_append(u.trail, l.parent) from up u join l on l.child = u.ancestor where not list_contains(u.trail, l.parent))
      select ancestor, descendant, cast(steps as bigint) as steps from up""",
    "p5_unfollowed": f"with recursive {_LINKS} select child as idx, parent as parent_idx from l where parent > (select min(x.parent) from l x where x.child = l.child)",
    "p7_near": _NEAR,
    "p7_found": f"select idx_a, idx_b from ({_NEAR})",
}

_DENY = "('pedestrian', 'steps', 'footway', 'construction', 'bic', 'cycleway', 'layby', 'bridleway', 'path')"
_MAPS = f"""with n as (select distinct idx, osm_id, lat, lon from node), w as (select distinct idx, osm_id from way),
r as (select distinct idx, osm_id from rel),
nt as (select distinct idx, pos, k, v from node_tag), wt as (select distinct idx, pos, k, v from way_tag),
rt as (select distinct idx, pos, k, v from rel_tag),
wr as (select distinct idx, pos, ref_osm_id, node_idx from way_ref),
rm as (select distinct idx, pos, mtype, ref_osm_id, ref_idx, role from rel_member),
e as (select 'node' as kind, idx, osm_id from n union all select 'way', idx, osm_id from w union all select 'relation', idx, osm_id from r),
pl as (select idx as node_idx, lat / 1e7 as lat, lon / 1e7 as lon from n where lat is not null and lon is not null),
pts as (select wr.idx, wr.pos, pl.lat, pl.lon from wr left join pl on pl.node_idx = wr.node_idx),
lines as (select * from pts where idx not in (select idx from pts where lat is null)),
hw as (select distinct idx from wt where k = 'highway'),
dr as (select distinct idx from wt where k = 'highway' and v not in {_DENY}),
seg as (select idx, pos, lat, lon, lead(lat) over o as lat2, lead(lon) over o as lon2, lead(pos) over o as p2 from pts window o as (partition by idx order by pos)),
dist as (select idx, pos, 2 * 6372797.560856e0 * asin(least(1e0, sqrt(power(sin(radians(lat2 - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon) / 2), 2)))) as metres from seg where p2 is not null),
len as (select hw.idx, case when bool_or(d.idx is not null and d.metres is null) then null else coalesce(sum(d.metres), 0) end as metres
  from hw left join dist d on d.idx = hw.idx group by hw.idx),
first_hw as (select idx, k, v from wt where k in ('highway', 'waterway') qualify row_number() over (partition by idx order by pos) = 1),
first_wide as (select idx, v, case when regexp_full_match(v, '[+]?[0-9]+') then try_cast(v as hugeint) end as num
  from wt where k in ('width', 'maxwidth') qualify row_number() over (partition by idx order by pos) = 1),
cw as (select f.idx, case when f.k = 'highway' then 'road' else 'river' end as category,
    case when f.k = 'highway' then null when x.idx is null then 1 else cast(x.num as bigint) end as width
  from first_hw f left join first_wide x on x.idx = f.idx
  where f.idx in (select idx from wr group by idx having count(*) >= 3)
    and ((f.k = 'highway' and coalesce(f.v not in {_DENY}, true)) or (f.k = 'waterway' and (x.idx is null or x.num <= 4294967295)))),
rk as (select idx, pos, case when k = 'type' and v = 'multipolygon' then 'm'
  when (k = 'leisure' and v = 'park') or (k = 'landuse' and v in ('recreation_ground', 'forest')) then 'p'
  when k = 'water' and v = 'lake' then 'l' end as kind from rt),
rmin as (select idx, min(pos) as m from rk where kind = 'm' group by idx),
cr as (select idx, case when bool_or(kind = 'p' and pos < m) then 'park' when bool_or(kind = 'l' and pos < m) then 'water'
    when arg_min(kind, pos) filter (kind in ('p', 'l') and pos > m) = 'p' then 'park' else 'water' end as category
  from rk join rmin using (idx) where kind in ('p', 'l') group by idx),
outers as (select rm.idx as rel_idx, rm.pos as member_pos, rm.ref_idx from rm join cr on cr.idx = rm.idx where mtype = 'way' and role = 'outer'),
ring as (select o.rel_idx, o.member_pos, o.ref_idx, p.pos, p.lat, p.lon from outers o left join pts p on p.idx = o.ref_idx),
rings as (select rel_idx, member_pos, pos, lat, lon from ring where pos is not null
  and rel_idx not in (select rel_idx from ring where ref_idx is null or (pos is not null and lat is null))),
fp as (select 'way' as kind, l.idx, category, width, 0 as part, pos, lat, lon from lines l join cw on cw.idx = l.idx
  union all select 'relation', rel_idx, category, null, member_pos, pos, lat, lon from rings join cr on cr.idx = rel_idx),
pub as (select 'node' as kind, idx from (select idx, v from nt where k = 'amenity' qualify row_number() over (partition by idx order by pos) = 1) where v = 'pub'
  union all select 'way', idx from (select idx, v from wt where k = 'amenity' qualify row_number() over (partition by idx order by pos) = 1) where v = 'pub'),
nwt as (select 'node' as kind, * from nt union all select 'way', * from wt),
ot as (select 0 as o, * from nt union all select 1, * from wt union all select 2, * from rt),
roads as (select * from lines where idx in (select idx from dr)),
b as (select min(lat) as y0, max(lat) as y1, min(lon) as x0, max(lon) as x1 from roads),
fb as (select min(lat) as y0, max(lat) as y1, min(lon) as x0, max(lon) as x1 from fp),
img as (select *, cast(trunc(4320e0 * ((y1 - y0) / (x1 - x0) / cos(y1 / 180e0 * pi()))) as bigint) as h from b),
px as (select distinct cast(trunc((s.lon - x0) * 4319e0 / (x1 - x0)) as bigint) as xa, cast(trunc((y1 - s.lat) * cast(h - 1 as double) / (y1 - y0)) as bigint) as ya,
    cast(trunc((s.lon2 - x0) * 4319e0 / (x1 - x0)) as bigint) as xb, cast(trunc((y1 - s.lat2) * cast(h - 1 as double) / (y1 - y0)) as bigint) as yb
  from seg s, img where p2 is not null and s.idx in (select idx from roads)),
draw as (select *, unnest(range(greatest(abs(xb - xa), abs(yb - ya)))) as i, greatest(abs(xb - xa), abs(yb - ya)) as big, least(abs(xb - xa), abs(yb - ya)) as small from px),
res as (select rm.*, e.idx as found from rm left join e on e.kind = rm.mtype and e.osm_id = rm.ref_osm_id)
"""

_MAP_SQL = {
    "road_length_total": "select count(metres) as ways, round(coalesce(sum(metres), 0) / 1000, 3) as km from len",
    "entity_counts": "select kind, count(*) as n from e group by kind",
    "scan_nodes": "select * from n",
    "scan_ways": "select w.idx, w.osm_id, count(wr.idx) as n_refs from w left join wr on wr.idx = w.idx group by 1, 2",
    "scan_relations": "select r.idx, r.osm_id, count(rm.idx) as n_members from r left join rm on rm.idx = r.idx group by 1, 2",
    "point_lookup": "select idx, lat, lon from n where idx in (0, 7, 100, 999)",
    "header_summary": "select 10000000 as coord_scale, min(lon) as bbox_left, max(lon) as bbox_right, max(lat) as bbox_top, min(lat) as bbox_bottom from n",
    "node_degrees": "select idx, round(lat / 1e7, 7) as lat_deg, round(lon / 1e7, 7) as lon_deg from n",
    "node_tags_exploded": "select * from nt",
    "way_tags_exploded": "select * from wt",
    "find_tag_name": "select idx, v as name from nt where k = 'name' qualify row_number() over (partition by idx order by pos) = 1",
    "has_tag_first_key": "select idx, idx in (select idx from pub where kind = 'node') as is_pub from n",
    "find_tag_by_drivable": f"select idx, v from wt where k = 'highway' and v not in {_DENY} qualify row_number() over (partition by idx order by pos) = 1",
    "highway_ways": "select idx from hw",
    "drivable_roads": "select idx from dr",
    "classify_ways": "select idx, category, width from cw",
    "semi_join_tagged": "select idx from n where idx in (select idx from nt)",
    "unresolved_refs": "select idx, pos, ref_osm_id from wr where not exists (select 1 from n where n.osm_id = wr.ref_osm_id)",
    "cities": """, fk as (select idx, k, v from nt where k in ('place', 'name', 'population') qualify row_number() over (partition by idx, k order by pos) = 1)
      select p.idx, a.v as name, cast(q.v as bigint) as population from fk p join fk a on a.idx = p.idx and a.k = 'name' join fk q on q.idx = p.idx and q.k = 'population'
      where p.k = 'place' and p.v = 'city' and a.v is not null and regexp_full_match(q.v, '[+]?[0-9]+') and try_cast(q.v as bigint) is not null""",
    "pub_names": """, nm as (select kind, idx, v from nwt where k = 'name' qualify row_number() over (partition by kind, idx order by pos) = 1)
      select pub.kind, pub.idx, coalesce(v, 'unknown pub name') as name from pub left join nm on nm.kind = pub.kind and nm.idx = pub.idx""",
    "pub_addresses": "select nwt.kind, nwt.idx, pos, k, v from nwt join pub on pub.kind = nwt.kind and pub.idx = nwt.idx where starts_with(k, 'addr:')",
    "way_refs_resolved": "select wr.idx, wr.pos, n.idx as node_idx from wr left join n on n.osm_id = wr.ref_osm_id",
    "compile_stats": """select (select count(*) from n) as nodes, (select count(*) from w) as ways, (select count(*) from r) as relations,
      (select count(*) from wr left join n on n.osm_id = wr.ref_osm_id where n.idx is null) + (select count(*) from res where found is null and mtype = 'node') as unresolved_nodes,
      (select count(*) from res where found is null and mtype = 'way') as unresolved_ways, (select count(*) from res where found is null and mtype = 'relation') as unresolved_relations""",
    "member_resolution": "select idx as rel_idx, pos, mtype, found as idx, role from res",
    "relation_self_join": "select idx as rel_idx, pos, found as member_idx from res where mtype = 'relation'",
    "members_by_type": "select mtype, count(*) as n, count(found) as resolved from res group by mtype",
    "way_coords": "select idx as way_idx, pos, round(lat, 7) as lat, round(lon, 7) as lon from lines",
    "road_segments": "select idx as way_idx, pos, round(metres, 3) as metres from dist where idx in (select idx from hw) and idx in (select idx from lines)",
    "road_length_per_way": "select idx as way_idx, round(metres, 3) as metres from len where metres is not null",
    "roads_bounds": "select round(y0, 7) as min_lat, round(y1, 7) as max_lat, round(x0, 7) as min_lon, round(x1, 7) as max_lon from b",
    "raster_transform": "select 4320 as width, h as height from img",
    "raster_pixels": """, mn as (select *, (2 * i * small + big) // (2 * big) as m from draw)
      select distinct xa + cast(sign(xb - xa) as bigint) * case when abs(yb - ya) > abs(xb - xa) then m else i end as x,
      ya + cast(sign(yb - ya) as bigint) * case when abs(yb - ya) > abs(xb - xa) then i else m end as y from mn""",
    "classify_relations": "select idx, category from cr",
    "classified_features": "select 'way' as kind, idx, category, width from cw union all select 'relation', idx, category, null from cr",
    "multipolygon_rings": "select rel_idx, member_pos, pos, round(lat, 7) as lat, round(lon, 7) as lon from rings",
    "multipolygon_sizes": "select rel_idx, count(*) as points from rings group by 1 union all select idx, 0 from cr where idx not in (select rel_idx from outers)",
    "feature_polylines": "select kind, idx, category, width, part, pos, round(lat, 7) as lat, round(lon, 7) as lon from fp",
    "feature_extent": "select round(y0, 7) as min_lat, round(y1, 7) as max_lat, round(x0, 7) as min_lon, round(x1, 7) as max_lon from fb",
    "svg_transform": "select round(800e0 / (x1 - x0), 5) as scale_x, round(600e0 / (y0 - y1), 5) as scale_y, round(-x0, 5) as shift_x, round(-y1, 5) as shift_y from fb",
    "river_group_width": "select arg_max(width, idx) as width from cw where category = 'river' and idx in (select idx from lines)",
    "debug_nodes": """, tx as (select idx, string_agg(coalesce(k, '') || '=' || coalesce(v, ''), ';' order by pos, coalesce(k, '') || '=' || coalesce(v, '')) as tags from nt group by idx)
      select n.idx, osm_id, round(lat / 1e7, 7) as lat, round(lon / 1e7, 7) as lon, coalesce(tags, '') as tags from n left join tx on tx.idx = n.idx where n.idx < 1000""",
    "debug_ways": """, tx as (select idx, string_agg(coalesce(k, '') || '=' || coalesce(v, ''), ';' order by pos, coalesce(k, '') || '=' || coalesce(v, '')) as tags from wt group by idx),
      rx as (select idx, string_agg(coalesce(cast(node_idx as varchar), '-'), ',' order by pos) as nodes from wr group by idx)
      select w.idx, osm_id, coalesce(tags, '') as tags, coalesce(nodes, '') as nodes from w left join tx on tx.idx = w.idx left join rx on rx.idx = w.idx where w.idx < 1000""",
    "debug_relations": """, tx as (select idx, string_agg(coalesce(k, '') || '=' || coalesce(v, ''), ';' order by pos, coalesce(k, '') || '=' || coalesce(v, '')) as tags from rt group by idx),
      mx as (select idx, string_agg(coalesce(mtype, '') || ':' || coalesce(cast(ref_idx as varchar), '-') || ':' || coalesce(role, ''), ',' order by pos) as members from rm group by idx)
      select r.idx, osm_id, coalesce(tags, '') as tags, coalesce(members, '') as members from r left join tx on tx.idx = r.idx left join mx on mx.idx = r.idx where r.idx < 3""",
    "ids_join": "select * from e",
    "id_to_idx": "select osm_id, row_number() over (order by osm_id) - 1 as rank from (select distinct osm_id from n)",
    "unsorted_ids": """, ro as (select idx, osm_id, row_number() over (order by osm_id, idx) as a, row_number() over (order by idx, osm_id) as b from n)
      select idx, osm_id from ro where a <> b""",
    "id_block_offsets": "select block, n, cast(coalesce(sum(n) over (order by block rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from (select osm_id >> 12 as block, count(distinct osm_id) as n from n group by 1)",
    "bitmap_rank": "select osm_id, row_number() over (order by osm_id) - 1 as rank from (select distinct osm_id from n where osm_id is not null)",
    "tag_dictionary": "select k, v, row_number() over (order by o, idx, pos) - 1 as dict_idx from (select k, v, o, idx, pos from ot qualify row_number() over (partition by k, v order by o, idx, pos) = 1)",
    "string_table": """, ss as (select o, idx, pos, 0 as side, k as s from ot where k is not null union all select o, idx, pos, 1, v from ot where v is not null),
      fs as (select * from ss qualify row_number() over (partition by s order by o, idx, pos, side) = 1)
      select s, cast(coalesce(sum(strlen(s) + 1) over (order by o, idx, pos, side rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset from fs""",
    "tag_ranges": """, sz as (select n.idx, count(nt.idx) as c from n left join nt on nt.idx = n.idx group by n.idx),
      ru as (select idx, c, cast(sum(c) over (order by idx) as bigint) as l from sz) select idx, l - c as "first", l as "last" from ru""",
    "delta_decode": "select idx as way_idx, pos, ref_osm_id - lag(ref_osm_id, 1, 0) over (partition by idx order by pos) as delta, ref_osm_id from wr",
    "i40_roundtrip": "select osm_id, osm_id & 255 as b0, (osm_id >> 8) & 255 as b1, (osm_id >> 16) & 255 as b2, (osm_id >> 24) & 255 as b3, (osm_id >> 32) & 255 as b4, osm_id & 1099511627775 as value from n",
    "granularity_gcd": ", gs as (select distinct count(*) * 100 as g from wr group by idx) select cast(list_reduce(list_prepend(1000000000, list(g)), lambda a, b: gcd(a, b)) as bigint) as gcd from gs",
    "block_order": """, bs as (select case kind when 'node' then 0 when 'way' then 1 else 2 end as kind_order, idx // 8000 as block, min(osm_id) as first_id, count(*) as n from e group by 1, 2)
      select row_number() over (order by kind_order, block) - 1 as place, kind_order, block, first_id, n from bs""",
}
#: Ray casting: every node against every edge of every outline.
_MAP_SQL["p7_regions"] = """, mem as (select rm.idx as rel_idx, rm.pos as member_pos, rm.ref_idx from rm join cr on cr.idx = rm.idx where mtype = 'way' and role in ('outer', 'inner')),
      mp as (select m.rel_idx, m.member_pos, m.ref_idx, p.pos, p.lat, p.lon from mem m left join pts p on p.idx = m.ref_idx),
      mg as (select * from mp where pos is not null and rel_idx not in (select rel_idx from mp where ref_idx is null or (pos is not null and lat is null))),
      eg as (select rel_idx, lon as x1, lat as y1, coalesce(lead(lon) over o, first(lon) over o) as x2, coalesce(lead(lat) over o, first(lat) over o) as y2 from mg window o as (partition by rel_idx, member_pos order by pos)),
      hit as (select eg.rel_idx, pl.node_idx as idx from eg join pl on (y1 > pl.lat) <> (y2 > pl.lat) and pl.lon < (x1 + (x2 - x1) * (pl.lat - y1) / (y2 - y1)))
      select rel_idx, idx from hit group by rel_idx, idx having count(*) % 2 = 1"""
SQL |= {name: _MAPS + sql for name, sql in _MAP_SQL.items()}
