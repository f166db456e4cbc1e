"""DuckDB SQL of the registered queries, written apart from their Spark plans. Built from named pieces; every query is one statement."""

from __future__ import annotations

from .operators.frames import BOOLEAN, CIRCULAR, FEATURES, NUMERIC, catalogue
from .operators.windows import SCALES, frames_of, label
from .sources.pose import node_map

D = "::double"


def r(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def hz(a: str, p: float) -> str:
    """Mid-point quantile of a sorted list."""
    h = f"least(greatest(len({a}){D} * {p}{D} + 0.5{D}, 1.0{D}), len({a}){D})"
    return f"({a}[floor({h})::bigint] + ({h} - floor({h})) * ({a}[ceil({h})::bigint] - {a}[floor({h})::bigint]))"


def sorted_list(x: str) -> str:
    return f"list_sort(list({x}) filter (where ({x}) is not null))"


def with_(parts: dict[str, str], select: str) -> str:
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in parts.items()) + "\n" + select


TRACK = "session_idx, animal, node"
KEYS = "session_idx, animal, node, frame"
W = f"(partition by {TRACK} order by frame)"


def rows(frame: str, keys: str = TRACK) -> str:
    return f"(partition by {keys} order by frame rows between {frame})"


BEFORE, AFTER = "unbounded preceding and 1 preceding", "1 following and unbounded following"

POSE = {
    "slots": f"""select vec_id, a::integer animal, n::integer node, embedding[((a - 1) * 13 + (n - 1)) * 2 + 1]{D} ex,
      embedding[((a - 1) * 13 + (n - 1)) * 2 + 2]{D} ey, embedding[53 + (n - 1) % 12]{D} es from embeddings, range(1, 3) t(a), range(1, 14) u(n)""",
    "pose": f"""select printf('session_%04d', vec_id // 250 + 1) session_id, (vec_id // 250 + 1)::integer session_idx, (vec_id % 250 + 1)::integer frame,
      (vec_id % 250) / 80.0{D} time_s, animal, node, case when abs(ex) <= 0.3{D} then 200.0{D} + 100.0{D} * ex + (3 * node + 40 * animal) end x,
      case when abs(ex) <= 0.3{D} then 200.0{D} + 100.0{D} * ey + (3 * node + 40 * animal) end y, least(1.0{D}, abs(es) * 4.0{D}) score,
      (vec_id % 250 + 1) % 97 = 0 excluded from slots""",
}


def disp(src: str, dst: str = "moved", to: str = "disp") -> dict:
    return {dst: f"select *, sqrt((x - lag(x) over {W}) * (x - lag(x) over {W}) + (y - lag(y) over {W}) * (y - lag(y) over {W})) {to} from {src}"}


def conf(src: str = "pose") -> dict:
    return {
        "thr0": f"select {TRACK}, {sorted_list('score')} s, count(*){D} n from {src} group by all",
        "thr1": f"select *, coalesce(greatest(0.03{D}, {hz('s', 0.02)}), 0.03{D}) t0 from thr0",
        "thr2": f"select *, len(list_filter(s, lambda v: v < t0)) / n f0 from thr1",
        "thr": f"""select {TRACK}, threshold, f0 > 0.5{D} was_relaxed, f0 mask_fraction_initial, len(list_filter(s, lambda v: v < threshold)) / n mask_fraction_final
          from (select *, case when f0 > 0.5{D} then least(t0, 0.01{D}) else t0 end threshold from thr2)""",
        "masked": f"""select * exclude (x, y, threshold), case when not low_conf then x end x, case when not low_conf then y end y
          from (select p.*, threshold, coalesce(score < threshold, false) low_conf from {src} p join thr using ({TRACK}))""",
    }


def jumps(src: str) -> dict:
    limit = 25.0 * 1.97
    good = "x is not null and y is not null and not excluded"
    return disp(src, "jd") | {
        "jcut": f"select {TRACK}, case when n >= 10 then least({hz('s', 0.995)}, {limit!r}{D}) end cutoff from (select {TRACK}, {sorted_list('disp')} s, count(*) filter (where {good}) n from jd group by all)",
        "jbad": f"select jd.*, cutoff, coalesce(disp > cutoff and not excluded, false) b from jd join jcut using ({TRACK})",
        "jwide": f"select *, bool_or(b) over {rows('1 preceding and 1 following')} and not excluded fl from jbad",
        "jumped": f"select * exclude (b, fl), fl and (count(*) filter (where {good} and not fl) over (partition by {TRACK})) >= 2 jump from jwide",
    }


def hide(src: str, mask: str, dst: str) -> dict:
    return {dst: f"select * exclude (x, y), case when not {mask} then x end x, case when not {mask} then y end y from {src}"}


def gaps(src: str, dst: str, method: str = "linear", filled: str = "filled") -> dict:
    there = "x is not null and y is not null"
    near = lambda k, f, w: f"{f}(case when {there} then {k} end ignore nulls) over {rows(w)}"
    cols = ", ".join(f"{near(k, 'last_value', BEFORE)} a_{k}, {near(k, 'first_value', AFTER)} b_{k}" for k in ("frame", "time_s", "x", "y"))
    share = "((time_s - a_time_s) / (b_time_s - a_time_s))"
    value = lambda c: f"a_{c} + (b_{c} - a_{c}) * {share}" if method == "linear" else f"case when {share} >= 0.5 then b_{c} else a_{c} end"
    limit = "case when node in (9, 10, 13) then 15 when node between 5 and 8 then 5 else 8 end"
    fill = f"(not ({there}) and a_frame is not null and b_frame is not null and b_frame - a_frame - 1 <= {limit} and good >= 2)"
    helper = [f"{s}_{k}" for s in "ab" for k in ("frame", "time_s", "x", "y")]
    return {
        f"{dst}_n": f"select *, {cols}, count(*) filter (where {there}) over (partition by {TRACK}) good from {src}",
        dst: f"select * exclude (x, y, good, {', '.join(helper)}), case when {fill} then {value('x')} else x end x, case when {fill} then {value('y')} else y end y, {fill} {filled} from {dst}_n",
    }


PAIRS = [(1, 10), (2, 10), (5, 10), (6, 10), (7, 10), (8, 10)]


def geometry(src: str) -> dict:
    pairs = ", ".join(map(str, PAIRS))
    return disp(src, "gd", "move") | {
        "gp": f"""select a.session_idx, a.animal, a.frame, n1, n2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) dd, a.score s1, b.score s2,
          case when a.frame = 1 then 0.0 else a.move end d1, case when b.frame = 1 then 0.0 else b.move end d2
          from (values {pairs}) q(n1, n2) join gd a on a.node = n1 join gd b on b.node = n2 and a.session_idx = b.session_idx and a.animal = b.animal and a.frame = b.frame""",
        "gl": f"select session_idx, animal, n1, n2, {hz('s', 0.01)} low, {hz('s', 0.99)} high from (select session_idx, animal, n1, n2, {sorted_list('dd')} s from gp group by all) where len(s) >= 20",
        "gb": """select distinct session_idx, animal, frame, case
          when s1 = s2 then case when coalesce(d2 > d1, false) then n2 else n1 end when s2 < s1 then n2 when s1 < s2 then n1
          when s1 is not null and s2 is null then n2 else n1 end node
          from gp join gl using (session_idx, animal, n1, n2) where dd < low or dd > high""",
        "gmask": f"select g.*, b.node is not null geom from {src} g left join gb b using (session_idx, animal, frame, node)",
    }


def bounds(src: str, lo: float, hi: float, margin: float, ok: str = "true") -> dict:
    use = f"node = 10 and not excluded and x is not null and y is not null and {ok}"
    side = lambda c, p, s: f"case when n >= 50 then {hz(c, p)} {s} {margin}{D} end"
    return {
        "ab0": f"select session_idx, animal, list_sort(list(x) filter (where {use})) xs, list_sort(list(y) filter (where {use})) ys, count(*) filter (where {use}) n from {src} group by all",
        "ab": f"select session_idx, animal, n, {side('xs', lo, '-')} x0, {side('xs', hi, '+')} x1, {side('ys', lo, '-')} y0, {side('ys', hi, '+')} y1 from ab0",
        "amask": f"select p.*, coalesce((x < x0 or x > x1 or y < y0 or y > y1) and x is not null and y is not null, false) arena from {src} p join ab using (session_idx, animal)",
    }


CLEAN = (
    POSE | conf() | jumps("masked") | hide("jumped", "jump", "j1") | gaps("j1", "f1", filled="fill1") | geometry("f1") | hide("gmask", "geom", "g1")
    | bounds("g1", 0.01, 0.99, 40.0, "not geom") | hide("amask", "arena", "a1") | gaps("a1", "f2", filled="fill2")
    | {"clean": "select *, fill1 or fill2 interp, x is null or y is null final_nan from f2"}
)
FRACTIONS = ", ".join(f"avg({m}::int{D}) frac_{m}" for m in ("final_nan", "interp", "jump", "geom", "arena", "low_conf"))
_FRAC = [f"frac_{m}" for m in ("final_nan", "interp", "jump", "geom", "arena", "low_conf")]
WA = "(partition by session_idx, animal order by frame)"


def wide_qc(src: str) -> str:
    at = lambda n, c, k: f"max({c}) filter (where node = {n}) {c}{k}"
    return ", ".join(at(n, c, k) for n, k in ((1, 1), (10, 2), (10, 0)) for c in "xy")


def frame_qc(expand: int = 0) -> dict:
    severe = f" or bool_or(excluded or frac_arena > 0 or frac_geom > 0) over (partition by session_idx, animal order by frame rows between {expand} preceding and {expand} following)" if expand else ""
    return CLEAN | {
        "fq0": f"select session_idx, animal, frame, {FRACTIONS}, bool_or(excluded) excluded, {wide_qc('clean')} from clean group by all",
        "fq1": f"select *, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) body_length, sqrt((x0 - lag(x0) over {WA}) ** 2 + (y0 - lag(y0) over {WA}) ** 2) st from fq0",
        "fql": f"select session_idx, animal, {sorted_list('body_length')} s from fq1 group by all",
        "fq2": f"""select fq1.*, coalesce(len(s) >= 10 and (body_length < {hz('s', 0.01)} or body_length > {hz('s', 0.99)}), false) body_length_outlier,
          st / greatest(coalesce(body_length, 2.220446049250313e-16{D}), 2.220446049250313e-16{D}) anchor_disp_ratio from fq1 join fql using (session_idx, animal)""",
        "fq": f"""select *, excluded or body_length_outlier or frac_final_nan > 0.25 or frac_interp > 0.35 or frac_jump > 0.35 or frac_geom > 0.35 or frac_arena > 0.35
          or frac_low_conf > 0.5 or body_length is null{severe} bad from fq2""",
    }


def medians(src: str, tag: str) -> dict:
    return {
        f"md_{tag}": f"select session_idx, animal, frame, {wide_qc(src)} from {src} group by all",
        f"ms_{tag}": f"select session_idx, animal, sqrt((x0 - lag(x0) over {WA}) ** 2 + (y0 - lag(y0) over {WA}) ** 2) s, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) b from md_{tag}",
        f"mm_{tag}": f"select session_idx, animal, median(s) median_anchor_step_{tag}, median(b) median_body_length_{tag} from ms_{tag} group by all",
    }


def animals() -> dict:
    pct = ", ".join(f"100 * avg((frac_{k} > 0)::int{D}) pct_{k}_frames" for k in ("interp", "jump", "geom", "arena", "low_conf"))
    return frame_qc() | medians("clean", "clean") | medians("pose", "raw") | {
        "an0": f"""select session_idx, animal, count(*) n_frames, 100 * avg(bad::int{D}) pct_bad, {pct}, 100 * avg(frac_jump) pct_jump_samples, 100 * avg(frac_interp) pct_interp_samples,
          median(body_length) median_body_length, median(anchor_disp_ratio) median_distortion, 100 * avg((frac_jump > 0)::int{D}) mask_pct_jump,
          100 * avg((frac_interp > 0)::int{D}) mask_pct_interp, 100 * avg((frac_final_nan > 0)::int{D}) mask_pct_final_nan from fq group by all""",
        "an": "select an0.*, median_anchor_step_clean, median_anchor_step_raw, median_body_length_raw from an0 join mm_clean using (session_idx, animal) join mm_raw using (session_idx, animal)",
    }


METRICS = ["pct_bad", "pct_interp_frames", "pct_jump_frames", "pct_geom_frames", "pct_arena_frames", "pct_low_conf_frames", "median_distortion"]
LIMITS = [25, 20, 20, 15, 10, 15, 0.10]


def session_medians() -> dict:
    return animals() | {"sm": "select session_idx, " + ", ".join(f"case when count({m}) = count(*) then median({m}) end {m}" for m in METRICS) + " from an group by all"}


# -- frame features


def features(px2mm: float = 1.0) -> dict:
    points = {"nose": 1, "body": 9, "tail": 10, "mid": 13}
    at = ", ".join(f"max({c}) filter (where animal = {a} and node = {n}) {k}{a}_{c}" for a in (1, 2) for k, n in points.items() for c in "xy")
    cent = ", ".join(f"list_avg(list_filter([body{a}_{c}, mid{a}_{c}, tail{a}_{c}], lambda v: v is not null)) c{a}_{c}" for a in (1, 2) for c in "xy")
    ws = "(partition by session_idx order by frame)"
    grad = lambda v: f"case when row_number() over {ws} = 1 then 0.0{D} else ({v} - lag({v}) over {ws}) * 80.0{D} end"
    norm = lambda x, y: f"sqrt(({x}) * ({x}) + ({y}) * ({y}))"
    unit = lambda name, x, y: f"({x}) / nullif({norm(x, y)}, 0) {name}_x, ({y}) / nullif({norm(x, y)}, 0) {name}_y"
    between = lambda name, a, b: unit(name, f"{b}_x - {a}_x", f"{b}_y - {a}_y")
    units = ", ".join([between("u1", "tail1", "nose1"), between("u2", "tail2", "nose2"), between("r", "c1", "c2"), between("g1", "nose1", "c2"), between("g2", "nose2", "c1"), between("nn1", "nose1", "nose2"), between("nn2", "nose2", "nose1"), between("nb1", "nose1", "body2"), between("nb2", "nose2", "body1")])
    gap = lambda a, b: norm(f"{a}_x - {b}_x", f"{a}_y - {b}_y")
    dot = lambda a, b: f"({a}_x * {b}_x + {a}_y * {b}_y)"
    angle = lambda a, b: f"degrees(atan2({a}_x * {b}_y - {a}_y * {b}_x, {dot(a, b)}))"
    cosine = lambda a, b: f"{dot(a, b)} / nullif({norm(f'{a}_x', f'{a}_y')} * {norm(f'{b}_x', f'{b}_y')}, 0)"
    dvr = "((v2_x - v1_x) * r_x + (v2_y - v1_y) * r_y)"
    e = {
        "centroid_dist": gap("c1", "c2"), "body2body_dist": gap("body1", "body2"), "head2head_dist": gap("nose1", "nose2"), "tailbase2tailbase_dist": gap("tail1", "tail2"),
        "nose1_to_body2_dist": gap("nose1", "body2"), "nose2_to_body1_dist": gap("nose2", "body1"), "nose1_to_tail2_dist": gap("nose1", "tail2"), "nose2_to_tail1_dist": gap("nose2", "tail1"),
        "partner_long_1": "(c2_x - c1_x) * u1_x + (c2_y - c1_y) * u1_y", "partner_lat_1": "(c2_y - c1_y) * u1_x - (c2_x - c1_x) * u1_y",
        "partner_long_2": "(c1_x - c2_x) * u2_x + (c1_y - c2_y) * u2_y", "partner_lat_2": "(c1_y - c2_y) * u2_x - (c1_x - c2_x) * u2_y",
        "facing_1_to_2": dot("u1", "g1"), "facing_2_to_1": dot("u2", "g2"), "mutual_facing": f"least({dot('u1', 'g1')}, {dot('u2', 'g2')})", "heading_diff_deg": angle("u1", "u2"), "cos_head_alignment": dot("u1", "u2"),
        "radial_speed_12": dvr, "tangential_speed_12": "(v2_y - v1_y) * r_x - (v2_x - v1_x) * r_y", "approach_speed_1": "(v1_x - v2_x) * r_x + (v1_y - v2_y) * r_y", "approach_speed_2": f"-{dvr}",
        "speed_alignment": cosine("v1", "v2"), "accel_alignment": cosine("a1", "a2"),
        "nose_bearing_1_deg": angle("u1", "nn1"), "nose_bearing_2_deg": angle("u2", "nn2"), "body_bearing_1_deg": angle("u1", "nb1"), "body_bearing_2_deg": angle("u2", "nb2"),
    }
    flag = lambda c: f"coalesce({c}, false)::int{D}"
    app = "(v1_x - v2_x) * r_x + (v1_y - v2_y) * r_y"
    e |= {
        "in_contact": flag(f"{e['centroid_dist']} <= 30"), "head_close": flag(f"{e['head2head_dist']} <= 30"), "body_close": flag(f"{e['body2body_dist']} <= 30"), "close_pair": flag(f"{e['centroid_dist']} <= 60"),
        "mutual_approach": flag(f"{app} > 0"), "withdrawal": flag(f"{app} < 0"),
        "asym_investigate": f"{flag(e['nose1_to_body2_dist'] + ' < ' + e['nose2_to_body1_dist'])} - {flag(e['nose2_to_body1_dist'] + ' < ' + e['nose1_to_body2_dist'])}",
    }
    core = " and ".join(f"{p}{a}_{c} is not null" for p in ("c", "nose", "body", "tail") for a in (1, 2) for c in "xy")
    smooth = ", ".join(f"case when coalesce(bool_and({f} in (0, 1)) over (partition by session_idx), true) then {f} else avg({f}) over (partition by session_idx order by frame rows between 2 preceding and 2 following) end {f}" for f in FEATURES[:27])
    return POSE | {
        "w0": f"select session_idx, frame, min(time_s) time_s, {at} from pose group by all",
        "w1": f"select *, {cent} from w0",
        "w2": "select *, " + ", ".join(f"{grad(f'c{a}_{c}')} v{a}_{c}" for a in (1, 2) for c in "xy") + " from w1",
        "w3": "select *, " + ", ".join(f"{grad(f'v{a}_{c}')} a{a}_{c}" for a in (1, 2) for c in "xy") + f", {units} from w2",
        "raw": f"select session_idx, frame, time_s, {core} frame_ok, " + ", ".join(f"{v} {k}" for k, v in e.items()) + " from w3",
        "feat": f"select session_idx, frame, time_s, frame_ok, {smooth}, {', '.join(FEATURES[27:])} from raw",
    }


def feature_query(names: list[str]) -> str:
    return with_(features(), f"select session_idx, frame, {', '.join(f'{r(n)} {n}' for n in names)} from feat")


# -- window summaries


def stat(f: str, s: str) -> str:
    n = f"count({f}) over g"
    if s in ("mean", "occupancy"):
        return f"avg({f}) over g" if s == "mean" else f"avg(b_{f}) over g"
    if s == "std":
        return f"case when {n} = 1 then 0.0{D} else stddev_samp({f}) over g end"
    if s in ("min", "max"):
        return f"{s}({f}) over g"
    if s == "delta":
        return f"last_value({f} ignore nulls) over g - first_value({f} ignore nulls) over g"
    if s == "slope":
        return f"case when {n} >= 2 then regr_slope({f}, case when {f} is not null then k_{f} end) over g * 80.0{D} end"
    if s == "onset_rate":
        first = lambda c: f"first_value({c} ignore nulls) over g"
        return f"case when {n} > 0 then (sum(r_{f}) over g + ({first(f'b_{f}')} = 1 and {first(f'r_{f}')} = 0)::int){D} / {n} end"
    c, s_ = f"avg(cos(radians({f}))) over g", f"avg(sin(radians({f}))) over g"
    return f"degrees(atan2({s_}, {c}))" if s == "circmean" else f"sqrt(({c}) ** 2 + ({s_}) ** 2)"


def scale(seconds: float, wanted: list[tuple[str, str]], full: bool, plain: bool = False, src: str = "feat", tag: str = "") -> dict:
    _, before, after = frames_of(seconds, 80.0)
    ws = "(partition by session_idx order by frame)"
    flat = sorted({f for f, _ in wanted})
    run = ", ".join([f"count({f}) over (partition by session_idx order by frame rows unbounded preceding) k_{f}" for f in flat if f in NUMERIC] + [f"({f} > 0.5)::int b_{f}" for f in flat if f in BOOLEAN])
    rise = ", ".join(f"case when b_{f} = 1 and coalesce(last_value(b_{f} ignore nulls) over (partition by session_idx order by frame rows between {BEFORE}), 0) = 0 then 1 else 0 end r_{f}" for f in flat if f in BOOLEAN)
    cols = "".join(f", {stat(f, s)} {f'{f}__{s}' if plain else label(f, s, seconds)}" for f, s in wanted)
    gate = " and valid_frame_fraction >= 1 - 0.1::double" if full else ""
    return {
        f"s1{tag}": f"select *, row_number() over {ws} pos, count(*) over (partition by session_idx) size{', ' + run if run else ''} from {src}",
        f"s2{tag}": f"select *{', ' + rise if rise else ''} from s1{tag}",
        f"s3{tag}": f"select session_idx, frame center_frame, time_s center_time_s, {seconds}{D} window_sec, avg(frame_ok::int{D}) over g valid_frame_fraction, pos, size{cols} from s2{tag} window g as (partition by session_idx order by frame rows between {before} preceding and {after} following)",
        f"s4{tag}": f"select * exclude (pos, size) from s3{tag} where pos > {before} and pos + {after} <= size{gate}",
    }


def scale_query(seconds: float, wanted: list[tuple[str, str]], full: bool = False) -> str:
    names = [label(f, s, seconds) for f, s in wanted]
    return with_(features() | scale(seconds, wanted, full), "select session_idx, center_frame, window_sec, " + ", ".join(f"{r(n)} {n}" for n in ["valid_frame_fraction", *names]) + " from s4")


MATRIX = ["centroid_dist", "partner_long_1", "approach_speed_1", "facing_1_to_2", "head2head_dist", "speed_alignment"]
CELLS = [(f, s) for f in MATRIX for s in ("mean", "std")]


def matrix(scales=SCALES, plain: bool = False, full: bool = True, name: str = "m", where: str = "true", tag: str = "") -> dict:
    out: dict = {f"src{tag}": f"select * from feat where {where}"}
    for i, s in enumerate(scales):
        out |= scale(s, CELLS, full, plain, f"src{tag}", f"{tag}_{i}")
    return out | {name: " union all by name ".join(f"select * from s4{tag}_{i}" for i in range(len(scales)))}


WIDE = [label(f, s, w) for w in SCALES for f, s in CELLS]
PLAIN = [f"{f}__{s}" for f, s in CELLS]
META = f"session_idx, center_frame, {r('center_time_s')} center_time_s, window_sec, {r('valid_frame_fraction')} valid_frame_fraction"
TABLE = features() | matrix(plain=True, full=False)


def stats_parts(names: list[str]) -> dict:
    melt = " union all ".join(f"select '{n}' feature, {i}::bigint pos, {n} v from m" for i, n in enumerate(names))
    return TABLE | {
        "long": melt,
        "st0": f"select feature, pos, count(v) valid_n, (count(*) - count(v)){D} / count(*) missing_frac, median(v) median, {sorted_list('v')} s, stddev_samp(v) sd, bool_and(v in (0, 1)) is_bin, count(*) filter (where v > 0.5){D} / count(*) prev from long group by all",
        "st1": "select feature, median(abs(v - median)) mad from long join st0 using (feature) group by all",
        "st": f"select feature, pos, valid_n, missing_frac, median, mad, {hz('s', 0.75)} - {hz('s', 0.25)} iqr, case when valid_n = 1 then 0.0 else sd end std, coalesce(is_bin, false) is_binary, case when is_bin then prev end prevalence from st0 join st1 using (feature)",
        "sc": "select feature, pos, coalesce(missing_frac <= 0.10 and mad > 1e-6 and iqr > 1e-6, false) base, case when missing_frac <= 0.10 and mad > 1e-6 and iqr > 1e-6 then 1 + iqr / mad end score from st",
    }


def rank_pairs(names: list[str]) -> str:
    one = lambda a, b: f"select '{a}' a, '{b}' b, corr(ra, rb) rho from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 ra, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 rb from m where {a} is not null and {b} is not null)"
    return " union all ".join(one(a, b) for i, a in enumerate(names) for b in names[i + 1 :])


def values(rows_: list[tuple], names: str) -> str:
    lit = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else f"'{v}'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, x)) + ')' for x in rows_)}) t({names})"


XY = f"{r('x')} x, {r('y')} y"
MASKS = "low_conf, jump, interp, geom, arena, final_nan"
GAP = {"gapped": "select *, x is null or y is null gap from pose"}


def runs(src: str, mask: str) -> dict:
    return {
        "rn1": f"select *, ({mask}) and not coalesce(lag({mask}) over {W}, false) st from {src}",
        "rn2": f"select *, sum(st::int) over {W} run from rn1",
        "rn": f"select {TRACK}, min(frame) run_start, max(frame) run_stop, count(*) run_length from rn2 where {mask} group by {TRACK}, run",
    }


_FQ = ", ".join(f"{r(c)} {c}" for c in [*_FRAC, "body_length"])
_AN = ["pct_bad", *[f"pct_{k}_frames" for k in ("interp", "jump", "geom", "arena", "low_conf")], "pct_jump_samples", "pct_interp_samples", "median_body_length", "median_distortion", "mask_pct_jump", "mask_pct_interp", "mask_pct_final_nan", "median_anchor_step_clean", "median_anchor_step_raw", "median_body_length_raw"]
_Z = ", ".join(f"{r(f'case when coalesce(stddev_samp({m}) over () > 0, false) then ({m} - avg({m}) over ()) / nullif(stddev_samp({m}) over (), 0) else 0.0 end')} {m}" for m in METRICS)
_FLAGS = ", ".join(f"coalesce({m} > {v}, false) flag_{m}" for m, v in zip(METRICS, LIMITS))
_NF = " + ".join(f"flag_{m}::bigint" for m in METRICS)
_RM = " + ".join(f"({n} is null)::int" for n in WIDE)
_SUPPLIER = {
    "pose": f"""select l_suppkey::integer session_idx, frame::integer frame, (frame - 1) / 80.0{D} time_s, a::integer animal, n::integer node,
      200.0{D} + l_quantity{D} + 3 * n + 40 * a + 100 * l_discount{D} x, 200.0{D} + l_extendedprice{D} / 1000 + 2 * n - 30 * a + 100 * l_tax{D} y
      from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) frame from lineitem), range(1, 3) t(a), range(1, 14) u(n)"""
}

ORACLE_SQL = {
    "pose_long": with_(POSE, f"select session_id, session_idx, frame, {r('time_s')} time_s, animal, node, {XY}, {r('score')} score, excluded from pose"),
    "session_validation": with_(POSE | {
        "p": "select session_idx, frame, min(time_s) t, count(*) n from pose group by all",
        "g": "select *, lead(t) over (partition by session_idx order by frame) - t dt from p",
        "f": "select session_idx, count(*) n_frames, min(dt) d, min(n) lo, max(n) hi from g group by all",
        "s": "select session_idx, count(distinct node) n_nodes, count(distinct animal) n_animals from pose group by all"},
        f"select session_idx, n_frames, n_nodes, n_animals, {r('d')} min_step_s, lo = hi and hi = n_nodes * n_animals complete, n_frames >= 2 and d > 0 and n_animals in (1, 2) and lo = hi and hi = n_nodes * n_animals ok from f join s using (session_idx)"),
    "missing_frames": with_(POSE, "select session_idx, frame, animal, bool_or(x is null or y is null) any_missing, bool_and(x is null and y is null) all_missing from pose group by all"),
    "conf_thresholds": with_(POSE | conf(), f"select {TRACK}, {r('threshold')} threshold, was_relaxed, {r('mask_fraction_initial')} mask_fraction_initial, {r('mask_fraction_final')} mask_fraction_final from thr"),
    "conf_mask": with_(POSE | conf(), f"select {KEYS}, {XY}, low_conf from masked"),
    "find_runs": with_(POSE | GAP | runs("gapped", "gap"), "select * from rn"),
    "dilate_mask": with_(POSE | GAP, f"select {KEYS}, gap, bool_or(gap) over {rows('2 preceding and 2 following')} wide from gapped"),
    "displacement": with_(POSE | disp("pose"), f"select {KEYS}, {r('disp')} disp from moved"),
    "jump_candidates": with_(POSE | jumps("pose"), f"select {KEYS}, {r('disp')} disp, {r('cutoff')} cutoff, jump from jumped"),
    "gap_fill_linear": with_(POSE | gaps("pose", "f"), f"select {KEYS}, {XY}, filled from f"),
    "gap_fill_nearest": with_(POSE | gaps("pose", "f", "nearest"), f"select {KEYS}, {XY}, filled from f"),
    "geometry_limits": with_(POSE | geometry("pose"), f"select session_idx, animal, n1, n2, {r('low')} low, {r('high')} high from gl"),
    "geometry_blame": with_(POSE | geometry("pose"), "select session_idx, animal, frame, node from gb"),
    "arena_bounds": with_(POSE | bounds("pose", 0.01, 0.99, 40.0), f"select session_idx, animal, n, {r('x0')} x0, {r('x1')} x1, {r('y0')} y0, {r('y1')} y1 from ab"),
    "arena_mask": with_(POSE | bounds("pose", 0.05, 0.95, 1.0) | hide("amask", "arena", "h"), f"select {KEYS}, {XY}, arena from h"),
    "smooth_segments": with_(POSE | {"free": "select *, x is not null and y is not null ok from pose"} | runs("free", "ok"), "select * from rn where run_length >= 20"),
    "clean_native": with_(CLEAN, f"select {KEYS}, {XY}, {MASKS} from clean"),
    "frame_qc": with_(frame_qc(), f"select session_idx, animal, frame, {_FQ}, body_length_outlier, {r('anchor_disp_ratio')} anchor_disp_ratio from fq"),
    "bad_frames": with_(frame_qc(), "select session_idx, animal, frame, bad from fq"),
    "bad_frames_pair": with_(frame_qc(), "select session_idx, frame, bool_or(bad) bad from fq group by all"),
    "bad_frames_expanded": with_(frame_qc(3), "select session_idx, animal, frame, bad from fq"),
    "node_qc": with_(CLEAN | {"nq": f"select session_idx, animal, node, {FRACTIONS} from clean group by all"}, f"select session_idx, animal, node, {', '.join(f'{r(c)} {c}' for c in _FRAC)} from nq"),
    "session_qc": with_(animals(), f"select session_idx, animal, n_frames, {', '.join(f'{r(c)} {c}' for c in _AN)} from an"),
    "review_session": with_(frame_qc() | {
        "a": "select session_idx, frame, bool_or(bad) any_, bool_and(bad) all_, count(*) k from fq group by all",
        "b": "select session_idx, frame, bool_or(x is null or y is null) m from pose group by all"},
        f"select session_idx, n_frames, n_animals, {r('pa')} pct_bad_any, {r('pl')} pct_bad_all, {r('pm')} pct_any_missing_raw from (select session_idx, count(*) n_frames, max(k) n_animals, 100 * avg(any_::int{D}) pa, 100 * avg(all_::int{D}) pl from a group by all) join (select session_idx, 100 * avg(m::int{D}) pm from b group by all) using (session_idx)"),
    "ranked_sessions": with_(session_medians(), f"select session_idx, {', '.join(f'{r(m)} {m}' for m in METRICS[:-1])}, row_number() over (order by pct_bad desc nulls first, session_idx) rank from sm"),
    "metric_zscore": with_(session_medians(), f"select session_idx, {_Z} from sm"),
    "qc_flags": with_(session_medians() | {"fl": f"select *, {_FLAGS} from sm", "fn": f"select *, {_NF} n_flags from fl"}, f"select * replace ({', '.join(f'{r(m)} as {m}' for m in METRICS)}), row_number() over (order by n_flags desc, pct_bad desc nulls first, session_idx) position from fn"),
    "qc_console_summary": with_(animals() | {"l": " union all ".join(f"select '{m}' metric, {m} v from an where {m} is not null" for m in METRICS), "q": "select metric, median(v) md, list_sort(list(v)) s, max(v) mx from l group by all"}, f"select metric, {r('md')} median, {r(hz('s', 0.9))} p90, {r('mx')} max from q"),
    "qc_histogram": with_(POSE | disp("pose") | {"e": "select min(disp) lo, (max(disp) - min(disp)) / 25 w, count(disp) n from moved", "b": "select least(25, floor((disp - lo) / w)::bigint + 1) bin, lo, w, n from moved, e where disp is not null"}, f"select bin, {r('any_value(lo) + (bin - 1) * any_value(w)')} low, {r('any_value(lo) + bin * any_value(w)')} high, count(*) count, {r(f'count(*){D} / any_value(n)')} share from b group by bin"),
    "feat_distance": feature_query(FEATURES[0:8]),
    "feat_egocentric": feature_query(FEATURES[8:12]),
    "feat_orientation": feature_query(FEATURES[12:17] + FEATURES[23:27]),
    "feat_kinematics": feature_query(FEATURES[17:21]),
    "feat_coupling": feature_query(FEATURES[21:23]),
    "feat_contact": feature_query(FEATURES[27:31]),
    "feat_interaction": feature_query(FEATURES[31:34]),
    "frame_mask": with_(features() | frame_qc() | {"bp": "select session_idx, frame, bool_or(bad) b from fq group by all"}, f"select session_idx, frame, {r('time_s')} time_s, frame_ok and not coalesce(b, false) frame_ok from feat left join bp using (session_idx, frame)"),
    "feature_catalog": values(catalogue(), "name, family, is_directed, is_circular, is_boolean, transform_hint"),
    "contact_windows": with_(features() | scale(0.2, [("centroid_dist", "mean"), ("in_contact", "occupancy")], False), f"select {META}, {r('centroid_dist__mean__0_2s')} centroid_dist__mean__0_2s, {r('in_contact__occupancy__0_2s')} in_contact__occupancy__0_2s from s4"),
    "win_numeric": scale_query(0.2, [(f, s) for f in NUMERIC for s in ("mean", "std", "min", "max", "delta")], True),
    "win_slope": scale_query(0.5, [(f, "slope") for f in NUMERIC]),
    "win_prefix": scale_query(0.5, [(f, s) for f in NUMERIC for s in ("mean", "std", "slope")]),
    "win_boolean": scale_query(0.5, [(f, s) for f in BOOLEAN for s in ("occupancy", "onset_rate")]),
    "win_circular": scale_query(0.5, [(f, s) for f in CIRCULAR for s in ("circmean", "resultant")]),
    "win_valid_frac": with_(features() | {k: v for i, s in enumerate(SCALES) for k, v in scale(s, [], False, tag=f"_{i}").items()}, " union all ".join(f"select {META} from s4_{i}" for i in range(4))),
    "win_multiscale_wide": with_(features() | matrix(), f"select {META}, {', '.join(f'{r(n)} {n}' for n in WIDE)} from m"),
    "feature_matrix": with_(features() | matrix(name="m1", where="session_idx = 1", tag="_a") | matrix(SCALES[:2], name="m2", where="session_idx = 2", tag="_b") | {"m": "select * from m1 union all by name select * from m2"}, f"select {META}, {', '.join(f'{r(n)} {n}' for n in WIDE)} from m"),
    "feature_stats": with_(stats_parts(PLAIN), f"select feature, pos, valid_n, {', '.join(f'{r(c)} {c}' for c in ('missing_frac', 'median', 'mad', 'iqr', 'std'))}, is_binary, {r('prevalence')} prevalence from st"),
    "corr_pearson": with_(TABLE, " union all ".join(f"select '{a}' a, '{b}' b, {r(f'corr({a}, {b})')} rho from m" for i, a in enumerate(PLAIN) for b in PLAIN[i + 1 :])),
    "corr_spearman": with_(TABLE, f"select a, b, {r('rho')} rho from ({rank_pairs(PLAIN[:6])})"),
    "variable_scores": with_(stats_parts(PLAIN), f"select feature, pos, base, {r('score')} score from sc"),
    "topk_features": with_(stats_parts(PLAIN), f"select feature, {r('score')} score from sc where score is not null order by sc.score desc, pos limit 5"),
    "feature_report": with_(stats_parts(PLAIN[:5]) | {"rh": rank_pairs(PLAIN[:5]), "re": "select a feature, abs(rho) v from rh union all select b, abs(rho) from rh"}, f"select feature, valid_n, {r('median')} median, {r('mx')} max_abs_corr from st join (select feature, max(v) mx from re group by all) using (feature)"),
    "row_missing": with_(features() | matrix(full=False), f"select session_idx, center_frame, window_sec, {r(f'({_RM}){D} / {len(WIDE)}')} row_missing from m"),
    "session_dominance": with_(TABLE, f"select session_idx, count(*) n, {r(f'count(*){D} / sum(count(*)) over ()')} share from m group by session_idx"),
    "moving_mean_series": with_(POSE, f"select {KEYS}, {r('avg(x) over ' + rows('2 preceding and 2 following'))} x_mean from pose"),
    "hazen_quantiles": with_(POSE | {"q": f"select {TRACK}, {sorted_list('x')} s from pose group by all"}, f"select {TRACK}, {', '.join(f'{r(hz(chr(115), p))} q{int(p * 100)}' for p in (0.05, 0.25, 0.5, 0.75, 0.95))} from q"),
    "merge_outputs": with_(frame_qc() | {"bp": "select session_idx, frame, bool_or(bad) b from fq group by all"}, "select session_idx, any_value(session_id) session_id, any_value(n) n_bad from pose join (select session_idx, count(*) filter (where b) n from bp group by all) using (session_idx) group by session_idx"),
    "node_lookup": values(sorted(node_map().items()), "name, node"),
    "supplier_windows": with_({**_SUPPLIER, **{k: v for k, v in features().items() if k not in POSE}, **scale(0.5, [("centroid_dist", "mean"), ("centroid_dist", "max"), ("in_contact", "occupancy")], False)}, f"select session_idx, center_frame, window_sec, {r('valid_frame_fraction')} valid_frame_fraction, {r('centroid_dist__mean__0_5s')} centroid_dist__mean__0_5s, {r('centroid_dist__max__0_5s')} centroid_dist__max__0_5s, {r('in_contact__occupancy__0_5s')} in_contact__occupancy__0_5s from s4"),
}

# the queries on blocks have the rows of those on whole sessions
ORACLE_SQL |= {
    **{f"block_{b}": ORACLE_SQL[q] for b, q in {"win_numeric": "win_numeric", "win_prefix": "win_prefix", "win_boolean": "win_boolean", "win_circular": "win_circular", "kinematics": "feat_kinematics", "runs": "find_runs", "dilate": "dilate_mask", "displacement": "displacement"}.items()},
    "block_running": with_(POSE | disp("pose"), f"""select {KEYS}, count(x) over u seen, {r('coalesce(sum(disp) over u, 0)')} path, {r('last_value(x ignore nulls) over u')} last_x, {r('max(y) over u')} max_y
      from moved window u as (partition by {TRACK} order by frame rows between unbounded preceding and current row)"""),
}

_BOTH = " union all ".join(f"select '{a}' a, '{b}' b, count(*) n from m where {a} is not null and {b} is not null" for i, a in enumerate(PLAIN) for b in PLAIN[i + 1 :])
ORACLE_SQL |= {
    "rank_correlations": with_(TABLE, f"select a, b, n, {r('rho')} rho from ({rank_pairs(PLAIN)}) join ({_BOTH}) using (a, b)"),
    "inspection": with_(
        stats_parts(PLAIN) | {"rh": rank_pairs(PLAIN), "re": "select a feature, abs(rho) v from rh union all select b, abs(rho) from rh"},
        f"select feature, pos, valid_n, {', '.join(f'{r(c)} {c}' for c in ('missing_frac', 'median', 'mad', 'iqr', 'std'))}, is_binary, {r('prevalence')} prevalence, {r('mx')} max_abs_corr from st join (select feature, max(v) mx from re group by all) using (feature)",
    ),
}

ORACLE_SQL["win_extremes"] = scale_query(0.5, [(f, s) for f in NUMERIC for s in ("min", "max")])


def histogram_parts(src: str, keys: str, bins: int) -> dict:
    return {
        "hl": src,
        "he": f"select {keys}, min(v) lo, max(v) hi, (max(v) - min(v)) / {bins} w, count(v) n from hl group by all",
        "hb": f"select {keys}, case when hi = lo then 1 else least({bins}, floor((v - lo) / nullif(w, 0))::bigint + 1) end bin, lo, w, n from hl join he using ({keys})",
        "hh": f"select {keys}, bin, {r('any_value(lo) + (bin - 1) * any_value(w)')} low, {r('any_value(lo) + bin * any_value(w)')} high, count(*) count, {r(f'count(*){D} / any_value(n)')} share from hb group by {keys}, bin",
    }


ORACLE_SQL |= {
    "qc_histograms": with_(animals() | histogram_parts(" union all ".join(f"select '{m}' metric, {m}{D} v from an where {m} is not null" for m in METRICS), "metric", 25), "select * from hh"),
    "step_histograms": with_(POSE | disp("pose") | histogram_parts("select session_idx, animal, 'disp' metric, disp v from moved where node = 9 and disp is not null", "session_idx, animal, metric", 120), "select * from hh"),
    "track_extents": with_(POSE | {"ends": "select session_idx, min(frame) lo, max(frame) hi from pose group by all"}, f"""select {TRACK}, floor((frame - lo) * 40 / (hi - lo + 1))::integer pixel, min(frame) first_frame, max(frame) last_frame,
      {r('min(x)')} min_x, {r('max(x)')} max_x, {r('min(y)')} min_y, {r('max(y)')} max_y, count(x) n from pose join ends using (session_idx) group by {TRACK}, pixel"""),
}
