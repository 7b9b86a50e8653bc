"""Map projections as column expressions.

Transverse Mercator after Snyder, USGS Professional Paper 1395, equations 8-9 to 8-25; spherical
web Mercator. Each stage is its own column, so no intermediate is computed twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class TransverseMercator:
    lat0: float
    lon0: float
    k0: float
    false_east: float
    false_north: float


# GRS80 ellipsoid, web Mercator sphere, the two Korean grids.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
GRIDS = {
    5179: TransverseMercator(38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0),
    5186: TransverseMercator(38.0, 127.0, 1.0, 200_000.0, 600_000.0),
}

E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)


def meridian_coefficients() -> tuple[float, float, float, float]:
    return (
        1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256,
        3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024,
        15 * E2**2 / 256 + 45 * E2**3 / 1024,
        35 * E2**3 / 3072,
    )


def meridian_arc(lat: float) -> float:
    m0, m2, m4, m6 = meridian_coefficients()
    return SEMI_MAJOR * (
        m0 * lat - m2 * math.sin(2 * lat) + m4 * math.sin(4 * lat) - m6 * math.sin(6 * lat)
    )


def footpoint_coefficients() -> tuple[float, float, float, float]:
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    return (
        3 * e1 / 2 - 27 * e1**3 / 32,
        21 * e1**2 / 16 - 55 * e1**4 / 32,
        151 * e1**3 / 96,
        1097 * e1**4 / 512,
    )


def _stages(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df


def _to_grid(df: DataFrame, lon: str, lat: str, grid: TransverseMercator, out: tuple[str, str]):
    m0, m2, m4, m6 = meridian_coefficients()
    c = F.col
    df = _stages(
        df,
        {"_phi": F.radians(c(lat)), "_dlon": F.radians(c(lon) - F.lit(grid.lon0))},
        {"_sin": F.sin("_phi"), "_cos": F.cos("_phi"), "_tan": F.tan("_phi")},
        {
            "_n": F.lit(SEMI_MAJOR) / F.sqrt(1 - E2 * c("_sin") * c("_sin")),
            "_t": c("_tan") * c("_tan"),
            "_c": EP2 * c("_cos") * c("_cos"),
            "_a": c("_dlon") * c("_cos"),
            "_m": SEMI_MAJOR
            * (
                m0 * c("_phi")
                - m2 * F.sin(2 * c("_phi"))
                + m4 * F.sin(4 * c("_phi"))
                - m6 * F.sin(6 * c("_phi"))
            ),
        },
        {"_a2": c("_a") * c("_a")},
        {
            "_e": grid.k0 * c("_n") * c("_a")
            * (
                1
                + c("_a2") / 6
                * (
                    (1 - c("_t") + c("_c"))
                    + c("_a2") / 20
                    * (5 - 18 * c("_t") + c("_t") * c("_t") + 72 * c("_c") - 58 * EP2)
                )
            ),
            "_nn": grid.k0
            * (
                c("_m") - meridian_arc(math.radians(grid.lat0))
                + c("_n") * c("_tan") * c("_a2")
                * (
                    0.5
                    + c("_a2") / 24
                    * (
                        (5 - c("_t") + 9 * c("_c") + 4 * c("_c") * c("_c"))
                        + c("_a2") / 30
                        * (61 - 58 * c("_t") + c("_t") * c("_t") + 600 * c("_c") - 330 * EP2)
                    )
                )
            ),
        },
        {out[0]: c("_e") + grid.false_east, out[1]: c("_nn") + grid.false_north},
    )
    return df.drop(
        "_phi", "_dlon", "_sin", "_cos", "_tan", "_n", "_t", "_c", "_a", "_m", "_a2", "_e", "_nn"
    )


def _from_grid(df: DataFrame, x: str, y: str, grid: TransverseMercator, out: tuple[str, str]):
    f2, f4, f6, f8 = footpoint_coefficients()
    m0 = meridian_coefficients()[0]
    origin = meridian_arc(math.radians(grid.lat0))
    c = F.col
    df = _stages(
        df,
        {"_mu": (origin + (c(y) - grid.false_north) / grid.k0) / (SEMI_MAJOR * m0)},
        {
            "_f": c("_mu") + f2 * F.sin(2 * c("_mu")) + f4 * F.sin(4 * c("_mu"))
            + f6 * F.sin(6 * c("_mu")) + f8 * F.sin(8 * c("_mu"))
        },
        {"_sin": F.sin("_f"), "_cos": F.cos("_f"), "_tan": F.tan("_f")},
        {
            "_c": EP2 * c("_cos") * c("_cos"),
            "_t": c("_tan") * c("_tan"),
            "_w": 1 - E2 * c("_sin") * c("_sin"),
        },
        {"_n": SEMI_MAJOR / F.sqrt("_w")},
        {
            "_r": c("_n") * (1 - E2) / c("_w"),
            "_d": (c(x) - grid.false_east) / (c("_n") * grid.k0),
        },
        {"_d2": c("_d") * c("_d")},
        {
            "_lat": c("_f")
            - c("_n") * c("_tan") / c("_r") * c("_d2")
            * (
                0.5
                - c("_d2") / 24
                * (
                    (5 + 3 * c("_t") + 10 * c("_c") - 4 * c("_c") * c("_c") - 9 * EP2)
                    - c("_d2") / 30
                    * (
                        61 + 90 * c("_t") + 298 * c("_c") + 45 * c("_t") * c("_t")
                        - 252 * EP2 - 3 * c("_c") * c("_c")
                    )
                )
            ),
            "_lon": c("_d") / c("_cos")
            * (
                1
                - c("_d2") / 6
                * (
                    (1 + 2 * c("_t") + c("_c"))
                    - c("_d2") / 20
                    * (
                        5 - 2 * c("_c") + 28 * c("_t") - 3 * c("_c") * c("_c")
                        + 8 * EP2 + 24 * c("_t") * c("_t")
                    )
                )
            ),
        },
        {out[0]: F.degrees("_lon") + grid.lon0, out[1]: F.degrees("_lat")},
    )
    return df.drop("_mu", "_f", "_sin", "_cos", "_tan", "_c", "_t", "_w", "_n", "_r", "_d", "_d2",
                   "_lat", "_lon")


def reproject(
    df: DataFrame, x: str, y: str, src: int | None, dst: int, out: tuple[str, str],
    default_src: int = 5186,
) -> DataFrame:
    """Add columns `out` with (x, y) taken from EPSG `src` to EPSG `dst`.

    A missing `src` means that the file named no reference system; `default_src` applies then.
    """
    src = default_src if src is None else src
    known = {4326, 3857, *GRIDS}
    if src not in known or dst not in known:
        raise ValueError(f"unsupported reference system: {src} -> {dst}, know {sorted(known)}")
    if src == dst:
        return df.withColumns({out[0]: F.col(x), out[1]: F.col(y)})
    if src == 3857:
        df = df.withColumns({
            "_gx": F.degrees(F.col(x) / SEMI_MAJOR),
            "_gy": F.degrees(2 * F.atan(F.exp(F.col(y) / SEMI_MAJOR)) - math.pi / 2),
        })
    elif src in GRIDS:
        df = _from_grid(df, x, y, GRIDS[src], ("_gx", "_gy"))
    else:
        df = df.withColumns({"_gx": F.col(x), "_gy": F.col(y)})
    if dst == 4326:
        df = df.withColumns({out[0]: F.col("_gx"), out[1]: F.col("_gy")})
    elif dst == 3857:
        df = df.withColumns({
            out[0]: SEMI_MAJOR * F.radians("_gx"),
            out[1]: SEMI_MAJOR * F.log(F.tan(math.pi / 4 + F.radians("_gy") / 2)),
        })
    else:
        df = _to_grid(df, "_gx", "_gy", GRIDS[dst], out)
    return df.drop("_gx", "_gy")
