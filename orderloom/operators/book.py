"""Features of ten-level book snapshots held as arrays, best level first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scan import in_blocks
from orderloom.spec import BUY_SIDES, KEY, SELL_SIDES, TS, bucket, is_trade

EPS = 1e-9


def total(a: str | Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def first(a: str) -> Column:
    return F.get(a, F.lit(0))


def book_imbalance(book: DataFrame) -> DataFrame:
    """Bid against ask size, a level's weight being 1 / (level + 1); spread; total depth."""
    weighted = lambda a: total(F.transform(a, lambda x, i: x / (i + 1)))
    b = book.withColumn("_b", weighted("bid_sz")).withColumn("_a", weighted("ask_sz"))
    return b.withColumn("imbalance", (F.col("_b") - F.col("_a")) / F.greatest(F.col("_b") + F.col("_a"), F.lit(EPS))).withColumn("spread", first("ask_px") - first("bid_px")).withColumn("depth", total("bid_sz") + total("ask_sz")).drop("_a", "_b")


def top5_imbalance_microprice(book: DataFrame) -> DataFrame:
    b5, a5 = total(F.slice("bid_sz", 1, 5)), total(F.slice("ask_sz", 1, 5))
    b, a = first("bid_sz"), first("ask_sz")
    micro = F.when(a + b > 0, (first("bid_px") * a + first("ask_px") * b) / (a + b)).otherwise((first("bid_px") + first("ask_px")) / 2)
    return book.withColumn("imbalance5", (b5 - a5) / F.greatest(b5 + a5, F.lit(EPS))).withColumn("microprice", micro)


def mean_level_size(book: DataFrame, window: int = 200, snapshots: int = 20) -> DataFrame:
    """Adds mean_size: of the symbol's last `window` levels with any size, from the last snapshots, bids before asks in each.

    Blocks of rows with the snapshots before them: no task holds a symbol.
    """
    x, w, own = in_blocks(book, snapshots - 1)
    some = F.filter(F.concat("bid_sz", "ask_sz"), lambda v: v > 0)
    x = x.withColumn("_s", some).withColumn("_all", F.flatten(F.collect_list("_s").over(w.rowsBetween(-(snapshots - 1), 0))))
    kept = F.slice("_all", F.greatest(F.size("_all") - window + 1, F.lit(1)), window)
    return x.where(own).withColumn("mean_size", F.when(F.size("_all") > 0, total(kept) / F.size(kept))).select(*book.columns, "mean_size")


def wall_scan(book: DataFrame, factor: float = 3.0, window: int = 200, tick: float = 0.01) -> DataFrame:
    """The first level of each side whose size reaches `factor` times the mean of the last `window` levels: its place (bid_wall, ask_wall;
    -1 for none), price, strength (size by the mean), raw size, and distance from the mid price; wall_ticks is the nearer distance in ticks, 0 without a wall.
    """
    b = book if "mean_size" in book.columns else mean_level_size(book, window)
    mid = (first("bid_px") + first("ask_px")) / 2
    for side, sign in (("bid", 1.0), ("ask", -1.0)):
        at = F.coalesce(F.array_position(F.transform(f"{side}_sz", lambda x: x >= factor * F.col("mean_size")), F.lit(True)), F.lit(0)) - 1
        b = b.withColumn(f"{side}_wall", at)
        has, place = F.col(f"{side}_wall") >= 0, F.col(f"{side}_wall").cast("int")
        b = b.withColumn(f"{side}_wall_px", F.when(has, F.get(f"{side}_px", place))).withColumn(f"{side}_wall_size", F.when(has, F.get(f"{side}_sz", place)).otherwise(0.0))
        b = b.withColumn(f"{side}_wall_strength", F.when(has, F.col(f"{side}_wall_size") / F.greatest("mean_size", F.lit(EPS))).otherwise(0.0))
        b = b.withColumn(f"{side}_wall_distance", F.when(has, sign * (mid - F.col(f"{side}_wall_px"))))
    near = F.array_min(F.filter(F.array("bid_wall_distance", "ask_wall_distance"), lambda d: d > 0))
    return b.withColumn("wall_ticks", F.coalesce(near / tick, F.lit(0.0)))


# Weights of scarcity and of emptiness in a gap, the scarcity of a soft gap, and its least size.
SCARCE_WEIGHT, EMPTY_WEIGHT, SOFT_SCARCITY, SOFT_LEAST = 0.80, 0.60, 0.65, 1.60


def gap_and_density(book: DataFrame, tick: float = 0.01, gap: float = 2.0, window: int = 200) -> DataFrame:
    """For each side the first gap between levels with any size: its size (ticks between two levels, more where both are small beside the mean
    level size) and the price behind it; gap_size, the larger one; size of five levels for each tick that both sides' five levels span.

    A gap is hard from `gap` ticks on, soft from one tick on if the smaller level is scarce.
    """
    b = book if "mean_size" in book.columns else mean_level_size(book, window)
    mean = F.greatest("mean_size", F.lit(EPS))
    for side in ("bid", "ask"):
        ladder = F.filter(F.zip_with(f"{side}_px", f"{side}_sz", lambda p, z: F.struct(p.alias("p"), z.alias("z"))), lambda x: (x["p"] > 0) & (x["z"] > 0))
        b = b.withColumn("_l", ladder)

        def pair(i: Column) -> Column:
            a, c = F.get("_l", i), F.get("_l", i + 1)
            step = F.round(F.abs(a["p"] - c["p"]) / tick, 9)
            scarce = F.greatest(1 - F.least(a["z"], c["z"]) / mean, F.lit(0.0))
            size = step + SCARCE_WEIGHT * scarce + EMPTY_WEIGHT * F.greatest(1 - (a["z"] + c["z"]) / 2 / mean, F.lit(0.0))
            hit = (step >= gap) | ((step >= 1) & (scarce >= SOFT_SCARCITY) & (size >= max(gap, SOFT_LEAST)))
            return F.struct(hit.alias("hit"), size.alias("size"), c["p"].alias("px"))

        pairs = F.when(F.size("_l") > 1, F.transform(F.sequence(F.lit(0), F.size("_l") - 2), pair)).otherwise(F.array().cast("array<struct<hit:boolean,size:double,px:double>>"))
        b = b.withColumn("_g", F.get(F.filter(pairs, lambda x: x["hit"]), F.lit(0)))
        b = b.withColumn(f"{side}_gap_px", F.col("_g.px")).withColumn(f"{side}_gap_size", F.coalesce("_g.size", F.lit(0.0)))
        b = b.withColumn(f"_{side}5", total(F.transform(F.slice("_l", 1, 5), lambda x: x["z"]))).withColumn(f"_{side}s", F.abs(F.get("_l", F.least(F.size("_l") - 1, F.lit(4)))["p"] - F.get("_l", F.lit(0))["p"]) / tick)
    span = F.greatest(F.round(F.coalesce("_bids", F.lit(0.0)) + F.coalesce("_asks", F.lit(0.0)), 9), F.lit(1.0))
    b = b.withColumn("gap_size", F.greatest("bid_gap_size", "ask_gap_size"))
    b = b.withColumn("bid_density", F.col("_bid5") / span).withColumn("ask_density", F.col("_ask5") / span).withColumn("liquidity_density", F.col("bid_density") + F.col("ask_density"))
    return b.drop("_l", "_g", "_bid5", "_ask5", "_bids", "_asks")


def withdrawal_detector(book: DataFrame, window: int = 50) -> DataFrame:
    """Fall of the first three levels' depth without a trade, over traded size, in the last snapshots."""
    x, w, own = in_blocks(book, window)
    b = x.withColumn("_d", total(F.slice("bid_sz", 1, 3)) + total(F.slice("ask_sz", 1, 3))).withColumn("_p", F.lag("_d").over(w))
    b = b.withColumn("_r", F.when(~is_trade() & (F.col("_p") > F.col("_d")), F.col("_p") - F.col("_d")).otherwise(0.0)).withColumn("_t", F.when(is_trade(), F.col("size")).otherwise(0.0))
    f = w.rowsBetween(-(window - 1), 0)
    return b.withColumn("withdrawal", F.sum("_r").over(f) / F.greatest(F.sum("_t").over(f), F.lit(1.0))).where(own).select(*book.columns, "withdrawal")


def bar_book_snapshot(book: DataFrame, freq: str = "1 hour", top: int = 3) -> DataFrame:
    """symbol, time, bid_sz, ask_sz, bid0, ask0, imbalance: of each bar the blend of its snapshots of the largest imbalance, weighted by it (alike if all are 0)."""
    b_total, a_total = total("bid_sz"), total("ask_sz")
    b = book.withColumn("_m", F.round(F.abs((b_total - a_total) / (b_total + a_total + EPS)), 9)).withColumn("_b", bucket(freq))
    n = F.row_number().over(Window.partitionBy(KEY, "_b").orderBy(F.desc("_m"), TS, "seq"))
    row = F.struct("_m", "bid_sz", "ask_sz", first("bid_px").alias("bid0"), first("ask_px").alias("ask0"))
    b = b.withColumn("_n", n).where(F.col("_n") <= top).groupBy(KEY, F.col("_b").alias(TS)).agg(F.sort_array(F.collect_list(F.struct("_n", row.alias("r")))).alias("_r"))  # `top` rows a bar
    weights = total(F.transform("_r", lambda x: x["r"]["_m"]))
    share = lambda x: F.when(weights > 1e-12, x["r"]["_m"] / weights).otherwise(1 / F.size("_r"))
    b = b.withColumn("_w", F.transform("_r", lambda x: F.struct(share(x).alias("w"), x["r"].alias("r"))))
    blend = lambda value: F.aggregate("_w", F.lit(0.0), lambda s, x: s + x["w"] * value(x["r"]))
    levels = lambda c: F.transform(F.sequence(F.lit(0), F.size(F.col("_w")[0]["r"][c]) - 1), lambda i: blend(lambda r: F.greatest(F.get(r[c], i), F.lit(0.0))))
    b = b.withColumns({"bid_sz": levels("bid_sz"), "ask_sz": levels("ask_sz"), "bid0": blend(lambda r: r["bid0"]), "ask0": blend(lambda r: r["ask0"])})
    im = (total("bid_sz") - total("ask_sz")) / F.greatest(total("bid_sz") + total("ask_sz"), F.lit(EPS))
    return b.withColumn("imbalance", im).drop("_r", "_w")


def trade_footprint(ticks: DataFrame, snapshots: DataFrame, freq: str = "1 hour", levels: int = 10, unit: float = 1.0, fallback_tick: float = 0.01) -> DataFrame:
    """symbol, time, buy, sell: of each bar the traded size by distance from its best quotes, in units, level by level.

    Purchases are measured from the best ask, sales from the best bid, trades of unknown side from the mid price, from there on as
    purchases and below it as sales. A level is the spread wide. snapshots: bid0 and ask0 of a bar; bars without one are left out.
    """
    t = ticks.where(is_trade() & (F.col("size") > 0) & (F.col("price") > 0)).withColumn("_b", bucket(freq)).drop(TS).withColumnRenamed("_b", TS).join(snapshots.select(KEY, TS, "bid0", "ask0"), [KEY, TS])
    bid, ask = F.col("bid0"), F.col("ask0")
    spread = F.when((ask > 0) & (bid > 0) & (ask > bid), F.round(ask - bid, 9)).otherwise(F.lit(fallback_tick))
    side, mid = F.upper(F.trim("side")), (bid + ask) / 2
    buys, sells = side.isin(*BUY_SIDES), side.isin(*SELL_SIDES)
    is_buy = F.when(buys, True).when(sells, False).otherwise(F.col("price") >= mid)
    far = F.abs(F.col("price") - F.when(buys, ask).when(sells, bid).otherwise(mid)) / spread
    level = F.least(F.bround(F.round(far, 6)), F.lit(float(levels - 1))).cast("int")
    n = t.select(KEY, TS, is_buy.alias("_buy"), level.alias("_l"), (F.col("size") / unit).alias("_z")).groupBy(KEY, TS, "_buy", "_l").agg(F.sum("_z").alias("_z"))
    n = n.groupBy(KEY, TS).agg(F.collect_list(F.struct("_buy", "_l", "_z")).alias("_x"))  # two sides of `levels` at most
    ladder = lambda buy: F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda i: total(F.transform(F.filter("_x", lambda x: (x["_buy"] == buy) & (x["_l"] == i)), lambda x: x["_z"])))
    return n.select(KEY, TS, ladder(F.lit(True)).alias("buy"), ladder(F.lit(False)).alias("sell"))


CHANNELS = ("depth_log", "trade_imbalance", "trade_log", "bid_log", "ask_log", "buy_log", "sell_log", "wall", "depth_change")


def nine_channel_book(snapshots: DataFrame, footprint: DataFrame, wall_factor: float = 3.0, clip: float = 10.0) -> DataFrame:
    """symbol, time and nine arrays over the levels, the deepest bid first, the best bid and ask in the middle, the deepest ask last.

    A wall is over `wall_factor` times the median of the snapshot's sizes that are not 0. depth_change: against the symbol's bar before that has
    a snapshot, by its size (1 at least), clipped; 0 for the first. Sales stand on the bid side, purchases on the ask side.
    """
    zero = lambda c: F.transform(c, lambda x: F.lit(0.0))
    b = snapshots.select(KEY, TS, "bid_sz", "ask_sz", F.concat(F.reverse("bid_sz"), "ask_sz").alias("_d")).join(footprint, [KEY, TS], "left")
    b = b.withColumn("_buy", F.concat(zero("bid_sz"), F.coalesce("buy", zero("ask_sz")))).withColumn("_sell", F.concat(F.reverse(F.coalesce("sell", zero("bid_sz"))), zero("ask_sz")))
    b = b.withColumn("_p", F.lag("_d").over(Window.partitionBy(KEY).orderBy(TS)))
    some = F.sort_array(F.filter("_d", lambda x: x > 0))
    k = F.size(some)
    median = (F.get(some, F.floor((k - 1) / 2).cast("int")) + F.get(some, F.floor(k / 2).cast("int"))) / 2
    both = F.zip_with("_buy", "_sell", lambda x, y: F.struct(x.alias("b"), y.alias("s")))
    log = lambda c: F.transform(c, F.log1p)
    moved = F.zip_with("_d", "_p", lambda n, p: F.least(F.greatest((n - p) / F.greatest(p, F.lit(1.0)), F.lit(-clip)), F.lit(clip)))
    return b.select(
        KEY, TS, log("_d").alias("depth_log"), F.transform(both, lambda x: (x["b"] - x["s"]) / F.greatest(x["b"] + x["s"], F.lit(EPS))).alias("trade_imbalance"),
        F.transform(both, lambda x: F.log1p(x["b"] + x["s"])).alias("trade_log"), F.concat(log(F.reverse("bid_sz")), zero("ask_sz")).alias("bid_log"), F.concat(zero("bid_sz"), log("ask_sz")).alias("ask_log"),
        log("_buy").alias("buy_log"), log("_sell").alias("sell_log"), F.transform("_d", lambda x: F.coalesce(x > wall_factor * F.round(median, 9), F.lit(False)).cast("double")).alias("wall"),
        F.when(F.col("_p").isNull(), zero("_d")).otherwise(moved).alias("depth_change"),
    )


def tensor_cells(tensor: DataFrame) -> DataFrame:
    """symbol, time, level and the nine channels, a row a level."""
    x = tensor.select(KEY, TS, F.posexplode(F.arrays_zip(*CHANNELS)).alias("level", "z"))
    return x.select(KEY, TS, "level", *[F.col(f"z.{c}").alias(c) for c in CHANNELS])


def walk_the_book_fill(orders: DataFrame) -> DataFrame:
    """Size taken level by level from the other side: average price, filled, residual, levels used, worst price.

    orders: book columns with `is_buy` and `want`.
    """
    px, sz = F.when(F.col("is_buy"), F.col("ask_px")).otherwise(F.col("bid_px")), F.when(F.col("is_buy"), F.col("ask_sz")).otherwise(F.col("bid_sz"))
    o = orders.withColumn("_px", px).withColumn("_sz", sz)
    before = lambda i: total(F.slice("_sz", 1, i))
    take = F.transform("_sz", lambda x, i: F.greatest(F.least(x, F.col("want") - before(i)), F.lit(0.0)))
    o = o.withColumn("_take", take).withColumn("filled", total("_take"))
    o = o.withColumn("fill_vwap", F.when(F.col("filled") > 0, total(F.zip_with("_px", "_take", lambda p, t: p * t)) / F.col("filled")))
    return o.withColumn("residual", F.col("want") - F.col("filled")).withColumn("levels_used", F.size(F.filter("_take", lambda t: t > 0))).withColumn("worst_px", F.when(F.col("levels_used") > 0, F.get(F.transform(F.filter(F.zip_with("_px", "_take", lambda p, t: F.struct(p.alias("p"), t.alias("t"))), lambda z: z["t"] > 0), lambda z: z["p"]), F.col("levels_used") - 1))).drop("_px", "_sz", "_take")
