"""Main-content scoring formulas as column expressions (P18a-g, F1, F2, L1-L3).

All densities are closed forms (normal pdf, gamma pdf), so every score stays a
JVM expression inside whole-stage codegen.  Two parameter profiles exist:
``current`` (the maintained scorer) and ``legacy`` (the older variant).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scorer: position/size distributions and weights.
X_MEAN, X_SD = 0.5, 0.35
Y_MEAN, Y_SD = 0.5, 0.35
WIDTH_SHAPE, WIDTH_SCALE = 6.7, 0.11
HEIGHT_POWER = 1.5
MAX_NORMALIZED_HEIGHT = 0.9
MAIN_TAG_BONUS = 0.5
LINK_MEAN, LINK_SD_LOW, LINK_SD_HIGH = 6, 5, 30
TEXT_MEAN, TEXT_SD_LOW, TEXT_SD_HIGH = 50, 40, 1000
TEXT_POWER = 1.5
MIN_AREA = 0.05
CURRENT_INVALID_TAGS = ("NAV", "ASIDE", "HEADER", "FOOTER", "MENU", "BODY", "HTML")
LEGACY_INVALID_TAGS = ("NAV", "ASIDE", "HEADER", "FOOTER", "H1", "H2", "H3", "H4", "H5", "H6", "P", "BLOCKQUOTE",
                       "PRE", "A", "THEAD", "TFOOT", "TH", "DD", "DT", "MENU", "BODY", "HTML")

_LN_SQRT_2PI = 0.5 * math.log(2 * math.pi)
_GAMMA_LOG_NORM = math.lgamma(WIDTH_SHAPE) + WIDTH_SHAPE * math.log(WIDTH_SCALE)


@dataclass(frozen=True)
class Profile:
    name: str
    occupancy_peak: float
    occupancy_sigma: float
    depth_max: int
    depth_clamp: bool
    legacy_links: bool          # 0.2 * min(links, 5) instead of the link gaussian, no text score
    invalid_tags: tuple
    max_moves: int
    main_bonus_in_refine: bool
    repeat_rescored: bool       # rescoring lists repeat nodes (current scorer) or not (legacy)


CURRENT = Profile("current", 0.8, 0.3, 5, True, False, CURRENT_INVALID_TAGS, 5, False, True)
LEGACY = Profile("legacy", 0.6, 0.3, 7, False, True, LEGACY_INVALID_TAGS, 10, False, False)
PROFILES = {"current": CURRENT, "legacy": LEGACY}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_pdf(x: Column, mean: float, sd: float) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sd, 2) - F.lit(math.log(sd) + _LN_SQRT_2PI))


def gamma_pdf(x: Column) -> Column:
    """Γ(shape 6.7, scale .11) density; 0 for x <= 0."""
    return F.when(x > 0, F.exp((WIDTH_SHAPE - 1) * F.log(x) - x / WIDTH_SCALE - F.lit(_GAMMA_LOG_NORM))) \
            .otherwise(F.lit(0.0))


def occupancy_multiplier(rate: Column, peak: float = 0.8, sigma: float = 0.3, clamp: bool = True) -> Column:
    """Gaussian of the screen occupancy; null counts as 0."""
    r = F.coalesce(rate, F.lit(0.0))
    if clamp:
        r = F.greatest(r, F.lit(0.0))
    return F.exp(-0.5 * F.pow((r - peak) / sigma, 2))


def link_score(n_links: Column) -> Column:
    """0.1 without links; gaussian around 6 (sd 5 below, 30 above)."""
    n = F.coalesce(n_links, F.lit(0)).cast("double")
    return (F.when(n == 0, F.lit(0.1))
            .when(n <= LINK_MEAN, F.exp(-0.5 * F.pow((n - LINK_MEAN) / LINK_SD_LOW, 2)))
            .otherwise(F.exp(-0.5 * F.pow((n - LINK_MEAN) / LINK_SD_HIGH, 2))))


def text_score(text_len: Column) -> Column:
    """0 without text; gaussian around 50 chars (sd 40 below, 1000 above), ^1.5."""
    n = F.coalesce(text_len, F.lit(0)).cast("double")
    g = (F.when(n <= TEXT_MEAN, F.exp(-0.5 * F.pow((n - TEXT_MEAN) / TEXT_SD_LOW, 2)))
         .otherwise(F.exp(-0.5 * F.pow((n - TEXT_MEAN) / TEXT_SD_HIGH, 2))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.pow(g, TEXT_POWER))


def depth_weight(d: Column, max_depth: int = 5, base: float = 1.0, factor: float = 4.0, clamp: bool = True) -> Column:
    """P18e: base * factor^(max(0, d) / max_depth), not capped."""
    dd = F.greatest(d.cast("double"), F.lit(0.0)) if clamp else d.cast("double")
    return F.lit(base) * F.pow(F.lit(factor), dd / max_depth)


def base_score(rect: Column, ref_w: Column, ref_h: Column, n_links: Column, text_len: Column,
               profile: Profile = CURRENT) -> Column:
    """P18d: occupancy x position x size x link x text, against a reference box (W, H)."""
    x, y, w, h = rect["x"], rect["y"], rect["width"], rect["height"]
    has = rect.isNotNull()
    area = F.when(has, w * h).otherwise(F.lit(0.0))
    page_area = F.when(ref_w * ref_h > 0, ref_w * ref_h).otherwise(F.lit(1.0))
    occ = occupancy_multiplier(area / page_area, profile.occupancy_peak, profile.occupancy_sigma)
    wpos = ref_w > 0
    hpos = ref_h > 0
    xn = F.when(has & wpos, (x + w / 2) / ref_w).otherwise(F.lit(0.0))
    yn = F.when(has & hpos, y / ref_h).otherwise(F.lit(0.0))
    wn = F.when(has & wpos, w / ref_w).otherwise(F.lit(0.0))
    hn = F.when(has & hpos, h / ref_h).otherwise(F.lit(0.0))
    geo = (normal_pdf(xn, X_MEAN, X_SD) * normal_pdf(yn, Y_MEAN, Y_SD) * gamma_pdf(wn)
           * F.pow(F.least(hn, F.lit(MAX_NORMALIZED_HEIGHT)), HEIGHT_POWER))
    if profile.legacy_links:
        lf = 0.2 * F.least(F.coalesce(n_links, F.lit(0)), F.lit(5)).cast("double")
        return lf * occ * geo
    return occ * geo * link_score(n_links) * text_score(text_len)


def is_main_element(tag="tag", attributes="attributes") -> Column:
    """MAIN tag, or an ``id`` attribute containing "main" (any case); class is ignored."""
    t = _c(tag)
    idv = F.try_element_at(_c(attributes), F.lit("id"))
    return F.coalesce((t != "") & ((F.upper(t) == "MAIN") | F.lower(F.coalesce(idv, F.lit(""))).contains("main")),
                      F.lit(False))


def is_valid_element(tag="tag", rect="rect", profile: Profile = CURRENT) -> Column:
    """F2: tag present, not an excluded tag, area >= 0.05 (no rect counts as 0)."""
    t = _c(tag)
    r = _c(rect)
    area = F.when(r.isNotNull(), r["width"] * r["height"]).otherwise(F.lit(0.0))
    return F.coalesce((t != "") & ~F.upper(t).isin(*profile.invalid_tags) & (area >= MIN_AREA), F.lit(False))


def candidacy_score(rect="rect", page_w="page_w", page_h="page_h", n_links="n_links", text_len="text_len",
                    tag="tag", attributes="attributes", profile: Profile = CURRENT) -> Column:
    """P18f: base score against the page + 0.5 for a main element."""
    s = base_score(_c(rect), _c(page_w), _c(page_h), _c(n_links), _c(text_len), profile)
    return s + F.when(is_main_element(tag, attributes), F.lit(MAIN_TAG_BONUS)).otherwise(F.lit(0.0))


def refinement_score(rect: Column, root_w: Column, root_h: Column, depth: Column, root_depth: Column,
                     n_links: Column, text_len: Column, profile: Profile = CURRENT) -> Column:
    """P18g: base score against the root element's box x depth weight of (depth - root depth)."""
    s = base_score(rect, root_w, root_h, n_links, text_len, profile)
    return s * depth_weight(depth - root_depth, profile.depth_max, clamp=profile.depth_clamp)
