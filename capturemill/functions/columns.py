"""Column helpers: packed pair keys, names, number formats, pose arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the multiplier of the packed pair key.
PAIR_BASE = 2147483647

# Length limit and stand-in of the display name.
DISPLAY_LIMIT = 36
UNDETECTED = "Undetected"


def long_div(left: Column, right: int | Column) -> Column:
    """Integer division in long arithmetic, without a detour over doubles."""
    return F.call_function("div", left.cast("long"), F.lit(right).cast("long"))


# --- packed pair keys --------------------------------------------------------------------------

def encode_pair(id1: Column, id2: Column) -> Column:
    return id1.cast("long") * F.lit(PAIR_BASE).cast("long") + id2.cast("long")


def pair_first(pair_id: Column) -> Column:
    return long_div(pair_id, PAIR_BASE)


def pair_second(pair_id: Column) -> Column:
    return pair_id.cast("long") % F.lit(PAIR_BASE).cast("long")


# --- names and paths ---------------------------------------------------------------------------

def camera_name(make: Column, model: Column) -> Column:
    """Model, prefixed by its maker unless the model already names the maker."""
    maker = F.trim(F.coalesce(make, F.lit("")))
    label = F.trim(F.coalesce(model, F.lit("")))
    prefixed = (maker != "") & ~F.contains(F.upper(label), F.upper(maker))
    return (
        F.when(label == "", F.lit(UNDETECTED))
        .when(prefixed, F.concat_ws(" ", maker, label))
        .otherwise(label)
    )


def display_name(name: Column) -> Column:
    """Printable one-line form; longer names keep 35 characters followed by three dots."""
    filled = F.when(F.coalesce(name, F.lit("")) == "", F.lit(UNDETECTED)).otherwise(name)
    spaced = F.regexp_replace(filled, r"[\p{C}\p{Z}]", " ")
    clean = F.trim(F.regexp_replace(spaced, " +", " "))
    return (
        F.when(clean == "", F.lit(UNDETECTED))
        .when(F.char_length(clean) <= DISPLAY_LIMIT, clean)
        .otherwise(F.concat(F.substring(clean, 1, DISPLAY_LIMIT - 1), F.lit("...")))
    )


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normal_path(path: Column) -> Column:
    """Drop ``.`` segments, doubled and trailing slashes, and resolve ``..`` segments."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    rooted = path.startswith("/")

    def step(done: Column, segment: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        up = segment == ".."
        can_pop = (F.size(done) > 0) & (last != "..")
        popped = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(up & can_pop, popped)
            .when(up & rooted, done)
            .otherwise(F.array_append(done, segment))
        )

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def with_extension(path: Column, extension: str) -> Column:
    """Replace the last extension of the last segment; a name without one gets it appended."""
    stem = F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")
    return F.concat(stem, F.lit(extension))


def relative_path(path: Column, root: Column) -> Column:
    prefix = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    inside = path.startswith(prefix)
    return F.when(inside, F.substring(path, F.char_length(prefix) + 1, F.char_length(path))).otherwise(path)


# --- number formats ----------------------------------------------------------------------------

def thousands(value: Column, decimals: int = 0) -> Column:
    """``1,234.5`` with half-even rounding."""
    return F.format_number(value, decimals)


def fixed(value: Column, decimals: int) -> Column:
    """``1234.5`` with half-even rounding and no grouping."""
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


# --- viewer values -----------------------------------------------------------------------------

def flip_v(v: Column) -> Column:
    return F.lit(1.0) - v


def unit_color(*channels: Column) -> Column:
    """Colour bytes as fractions with alpha 1."""
    return F.array(*[c.cast("double") / 255.0 for c in channels], F.lit(1.0))


# --- poses -------------------------------------------------------------------------------------

def rotation_entries(q: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion (w, x, y, z) as 3 x 3 scalar columns."""
    w, x, y, z = (F.element_at(q, i) for i in (1, 2, 3, 4))
    return [
        [1 - 2 * y * y - 2 * z * z, 2 * x * y - 2 * z * w, 2 * x * z + 2 * y * w],
        [2 * x * y + 2 * z * w, 1 - 2 * x * x - 2 * z * z, 2 * y * z - 2 * x * w],
        [2 * x * z - 2 * y * w, 2 * y * z + 2 * x * w, 1 - 2 * x * x - 2 * y * y],
    ]


def rotation_matrix(q: Column) -> Column:
    return F.array(*[F.array(*row) for row in rotation_entries(q)])


def turned_back(rotation: Column, vector: list[Column]) -> list[Column]:
    """Transpose of the rotation applied to a vector."""
    def entry(row: int, col: int) -> Column:
        return F.element_at(F.element_at(rotation, row + 1), col + 1)

    return [
        entry(0, i) * vector[0] + entry(1, i) * vector[1] + entry(2, i) * vector[2]
        for i in range(3)
    ]


def camera_center(rotation: Column, t: Column) -> Column:
    x, y, z = turned_back(rotation, [F.element_at(t, i) for i in (1, 2, 3)])
    return F.struct((-x).alias("x"), (-y).alias("y"), (-z).alias("z"))
