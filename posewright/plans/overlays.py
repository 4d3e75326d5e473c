"""Overlay layers of a session: what a viewer draws on each frame, as semi-structured items.

Items of five shapes (box, skeleton, point, line, text) have no common columns, so each is a VARIANT. A layer has its
frames in order, and a frame a fixed number of items at most; layers are rows, so no session is one document in memory.
Coordinates are fractions of the frame; the arena lies in the coordinates of its reference frame and is mapped back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posewright.fixtures import POSES_SQL, poses
from posewright.functions import columns as c
from posewright.operators import geometry, series
from posewright.plans import arena_motion, enrichment, pose_queries

# fixed values: colours, labels and places of the items
COLOURS = {"my": "#ff8c00", "op": "#3c8ddc"}
LABELS = {"my": "ME", "op": "OP"}
ZONE_OPEN, ZONE_HIT = "#2ecc71", "#ff2222"
CLINCH, SWAP = ("#ff3333", (0.02, 0.10)), ("#ffaa00", (0.02, 0.14))
ARENA, CENTRE = "#ff8c00", "#ff4040"
#: Frames before and behind a hit in which its zone is shown as hit.
FLASH = 2


def item(kind: str, **parts: Column) -> Column:
    return F.to_variant_object(F.struct(F.lit(kind).alias("type"), *(v.alias(k) for k, v in parts.items())))


def box(at: Column, colour: Column | str, label: str | None = None) -> Column:
    return item("box", box=at, color=colour if isinstance(colour, Column) else F.lit(colour), **({"label": F.lit(label)} if label else {}))


def text(words: Column, place: tuple, colour: str) -> Column:
    return item("text", xy=F.array(*map(F.lit, place)), text=words, color=F.lit(colour))


def present(*items: tuple[Column, Column]) -> Column:
    """Items whose condition holds, in order."""
    kept = F.array(*(F.when(has, x) for has, x in items))
    return F.filter(kept, lambda x: x.isNotNull())


def layer(df: DataFrame, name: str, items: Column, sparse: bool) -> DataFrame:
    """(session, layer, fi, t, items); frames without an item only where the layer is not sparse."""
    rows = df.select("session", F.lit(name).alias("layer"), "fi", F.col("time_s").alias("t"), items.alias("items"))
    return rows.where(F.size("items") > 0) if sparse else rows


def enriched_layers(enriched: DataFrame) -> DataFrame:
    """Boxes of both, clinches, and the moments at which identities were exchanged."""
    both = present(*((F.col(f"{s}_box").isNotNull(), box(F.col(f"{s}_box"), COLOURS[s], LABELS[s])) for s in ("my", "op")))
    swapped = lambda why, name: (F.col(name).isNotNull(), text(F.lit(f"RE-ID SWAP ({why})"), SWAP[1], SWAP[0]))
    return (
        layer(enriched, "boxes", both, False)
        .unionByName(layer(enriched, "clinch", present((F.col("clinch"), text(F.lit("CLINCH"), CLINCH[1], CLINCH[0]))), True))
        .unionByName(layer(enriched, "reid_swaps", present(swapped("clinch_exit", "exit"), swapped("periodic_reid", "reid")), True))
    )


def arena_layer(frames: DataFrame, warps: DataFrame, arena: DataFrame) -> DataFrame:
    """The arena's centre and its longer axis on every frame, and both fighters' places on the floor."""
    f = frames.join(warps.select("session", "fi", "warp"), ["session", "fi"]).join(arena, "session")
    back = geometry.invert(F.col("warp"))
    on_frame = lambda x, y: F.array(*geometry.applied(back, x, y))
    reach = lambda sign: on_frame(F.col("cx") + sign * F.col("axis_len") * F.cos("angle"), F.col("cy") + sign * F.col("axis_len") * F.sin("angle"))
    feet = [(F.size(f"{s}_feet") > 0, item("point", xy=F.array(*(c.mean_of(F.col(f"{s}_feet"), a) for a in "xy")), color=F.lit(COLOURS[s]), radius=F.lit(4))) for s in ("my", "op")]
    known = F.col("cx").isNotNull()
    drawn = present((known, item("point", xy=on_frame(F.col("cx"), F.col("cy")), color=F.lit(CENTRE), radius=F.lit(6))), (known, item("line", a=reach(-1), b=reach(1), color=F.lit(ARENA))), *feet)
    return layer(f, "arena", drawn, False)


def zone_layer(frames: DataFrame, hits: Column) -> DataFrame:
    """Head and body targets of the opponent, in another colour around a hit, and the opponent's skeleton behind them."""
    lit = series.mark_around(frames, ["session"], hits, FLASH, FLASH)
    f = frames.withColumn("_lit", lit)
    colour = F.when(F.col("_lit"), ZONE_HIT).otherwise(ZONE_OPEN)
    zones = [c.head_zone(F.col("op_kps"), F.col("op_bbox")), c.stomach_zone(F.col("op_kps"))]
    drawn = present(*((z.isNotNull(), box(z, colour)) for z in zones), (F.col("op_kps").isNotNull(), item("skeleton", kps=F.col("op_kps"), color=F.lit(COLOURS["op"]))))
    return layer(f, "target_zones", drawn, False)


def read_back(layers: DataFrame) -> DataFrame:
    """One row an item: its place in the frame, its type, colour and text, and its first coordinates, told from the VARIANT."""
    rows = layers.select("session", "layer", "fi", F.posexplode("items").alias("place", "v"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    x = F.coalesce(get("$.box[0]", "double"), get("$.xy[0]", "double"), get("$.a[0]", "double"), get("$.kps[0][0]", "double"))
    y = F.coalesce(get("$.box[1]", "double"), get("$.xy[1]", "double"), get("$.a[1]", "double"), get("$.kps[0][1]", "double"))
    return rows.select("session", "layer", "fi", "place", get("$.type", "string").alias("type"), get("$.color", "string").alias("color"), F.coalesce(get("$.label", "string"), get("$.text", "string")).alias("text"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def bundle(layers: DataFrame) -> DataFrame:
    """(session, layer, fi, t, items as JSON): what a viewer fetches frame by frame."""
    return layers.withColumn("items", F.to_json(F.to_variant_object("items")))


def overlay_items(spark, d) -> DataFrame:
    """All layers of the poses view, written as VARIANT and read back."""
    frames = poses(spark, d)
    warps = arena_motion.anchored(arena_motion.to_first(arena_motion.pose_steps(frames)))
    arena = arena_motion.arena_on_floor(frames, warps).select("session", "cx", "cy", "axis_len", F.lit(0.0).alias("angle"))
    hits = F.coalesce(c.visibility(F.col("my_kps")) < 0.5, F.lit(False))
    layers = enriched_layers(enrichment.enrich(*enrichment.footage(spark, d))).unionByName(arena_layer(arena_motion.with_feet(frames), warps, arena)).unionByName(zone_layer(frames, hits))
    return read_back(layers)


QUERIES = {"overlay_items": overlay_items}

_ITEM = "SELECT session, '{layer}' AS layer, fi, {place} AS place, '{type}' AS type, {color} AS color, {text} AS text, {x} AS x, {y} AS y FROM {rows}"
_NONE = "CAST(NULL AS VARCHAR)"
_INVERSE = "(a * d - b * c)"
_ON_FRAME = lambda x, y: (f"(d * (({x}) - tx) - b * (({y}) - ty)) / {_INVERSE}", f"(a * (({y}) - ty) - c * (({x}) - tx)) / {_INVERSE}")
_ENRICHED, _SWAPS = f"({enrichment.ORACLES['enriched_frames']})", f"({enrichment.ORACLES['swap_events']})"
_PLACED = "CAST(row_number() OVER (PARTITION BY session, fi ORDER BY ord) - 1 AS INTEGER)"
_ON_ARENA = arena_motion._POSES + f""", {pose_queries._FEET}, fl AS (SELECT w.*, cx, cy, axis_len FROM warp w LEFT JOIN axis USING (session)),
  ar AS (SELECT session, fi, 0 AS ord, 'point' AS type, '{CENTRE}' AS color, {_ON_FRAME("cx", "cy")[0]} AS x, {_ON_FRAME("cx", "cy")[1]} AS y FROM fl WHERE cx IS NOT NULL UNION ALL SELECT session, fi, 1, 'line', '{ARENA}', {_ON_FRAME("cx - axis_len", "cy")[0]}, {_ON_FRAME("cx - axis_len", "cy")[1]} FROM fl WHERE cx IS NOT NULL
    UNION ALL SELECT session, fi, CASE WHEN side = 'my' THEN 2 ELSE 3 END, 'point', CASE WHEN side = 'my' THEN '{COLOURS["my"]}' ELSE '{COLOURS["op"]}' END, fx, fy FROM foot WHERE n > 0)
  SELECT session, 'arena' AS layer, fi, {_PLACED} AS place, type, color, {_NONE} AS text, round(x, 6) AS x, round(y, 6) AS y FROM ar"""
_ZONES = "WITH " + ", ".join([POSES_SQL, pose_queries._HEADZ.replace("{aspect}", "1.0"), pose_queries._STOMZ.replace("{aspect}", "1.0")]) + f""",
  lit AS (SELECT session, fi, max(CASE WHEN vis < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY fi ROWS BETWEEN {FLASH} PRECEDING AND {FLASH} FOLLOWING) = 1 AS hit FROM torso WHERE side = 'my'),
  zn AS (SELECT session, fi, 0 AS ord, 'box' AS type, zx1 AS x, top AS y FROM hb WHERE side = 'op' UNION ALL SELECT session, fi, 1, 'box', zx1, top FROM sz WHERE side = 'op' UNION ALL SELECT session, fi, 2, 'skeleton', x, y FROM kp WHERE side = 'op' AND i = 0)
  SELECT session, 'target_zones' AS layer, fi, {_PLACED} AS place, type, CASE WHEN type = 'skeleton' THEN '{COLOURS["op"]}' WHEN hit THEN '{ZONE_HIT}' ELSE '{ZONE_OPEN}' END AS color, {_NONE} AS text, round(x, 6) AS x, round(y, 6) AS y FROM zn JOIN lit USING (session, fi)"""
ORACLES = {"overlay_items": " UNION ALL ".join(f"SELECT * FROM ({q})" for q in (
    _ITEM.format(layer="boxes", place="0", type="box", color=f"'{COLOURS['my']}'", text="'ME'", x="my0", y="my1", rows=_ENRICHED) + " WHERE my0 IS NOT NULL",
    _ITEM.format(layer="boxes", place="CASE WHEN my0 IS NULL THEN 0 ELSE 1 END", type="box", color=f"'{COLOURS['op']}'", text="'OP'", x="op0", y="op1", rows=_ENRICHED) + " WHERE op0 IS NOT NULL",
    _ITEM.format(layer="clinch", place="0", type="text", color=f"'{CLINCH[0]}'", text="'CLINCH'", x=f"{CLINCH[1][0]}::DOUBLE", y=f"{CLINCH[1][1]}::DOUBLE", rows=_ENRICHED) + " WHERE clinch",
    _ITEM.format(layer="reid_swaps", place="CAST(row_number() OVER (PARTITION BY session, fi ORDER BY reason) - 1 AS INTEGER)", type="text", color=f"'{SWAP[0]}'", text="'RE-ID SWAP (' || reason || ')'", x=f"{SWAP[1][0]}::DOUBLE", y=f"{SWAP[1][1]}::DOUBLE", rows=_SWAPS),
    _ON_ARENA, _ZONES,
))}
