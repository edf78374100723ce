"""Colour functions as column expressions. Colours are `#rrggbb` or `#rrggbbaa`, or names of the palette."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The base names of the X11 palette with their red, green and blue; white comes first.
_BASE = (
    "white ffffff aliceblue f0f8ff antiquewhite faebd7 aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 "
    "black 000000 blanchedalmond ffebcd blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 "
    "chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed cornsilk fff8dc cyan 00ffff "
    "darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgreen 006400 darkkhaki bdb76b "
    "darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a "
    "darkseagreen 8fbc8f darkslateblue 483d8b darkslategray 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 "
    "deeppink ff1493 deepskyblue 00bfff dimgray 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 "
    "forestgreen 228b22 gainsboro dcdcdc ghostwhite f8f8ff gold ffd700 goldenrod daa520 gray bebebe green 00ff00 "
    "greenyellow adff2f honeydew f0fff0 hotpink ff69b4 indianred cd5c5c ivory fffff0 khaki f0e68c lavender e6e6fa "
    "lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff "
    "lightgoldenrod eedd82 lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgreen 90ee90 lightpink ffb6c1 "
    "lightsalmon ffa07a lightseagreen 20b2aa lightskyblue 87cefa lightslateblue 8470ff lightslategray 778899 "
    "lightsteelblue b0c4de lightyellow ffffe0 limegreen 32cd32 linen faf0e6 magenta ff00ff maroon b03060 "
    "mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 "
    "mediumslateblue 7b68ee mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 "
    "midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5 navajowhite ffdead navy 000080 "
    "oldlace fdf5e6 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa "
    "palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f "
    "pink ffc0cb plum dda0dd powderblue b0e0e6 purple a020f0 red ff0000 rosybrown bc8f8f royalblue 4169e1 "
    "saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57 seashell fff5ee sienna a0522d skyblue 87ceeb "
    "slateblue 6a5acd slategray 708090 snow fffafa springgreen 00ff7f steelblue 4682b4 tan d2b48c thistle d8bfd8 "
    "tomato ff6347 turquoise 40e0d0 violet ee82ee violetred d02090 wheat f5deb3 whitesmoke f5f5f5 yellow ffff00 "
    "yellowgreen 9acd32"
)
#: Families of X11 with four numbered shades; the first shade where it is not the base name's own colour.
_FAMILIES = (
    "aquamarine azure bisque blue brown burlywood=ffd39b cadetblue=98f5ff chartreuse chocolate=ff7f24 coral=ff7256 cornsilk cyan "
    "darkgoldenrod=ffb90f darkolivegreen=caff70 darkorange=ff7f00 darkorchid=bf3eff darkseagreen=c1ffc1 darkslategray=97ffff "
    "deeppink deepskyblue dodgerblue firebrick=ff3030 gold goldenrod=ffc125 green honeydew hotpink=ff6eb4 indianred=ff6a6a ivory "
    "khaki=fff68f lavenderblush lemonchiffon lightblue=bfefff lightcyan lightgoldenrod=ffec8b lightpink=ffaeb9 lightsalmon "
    "lightskyblue=b0e2ff lightsteelblue=cae1ff lightyellow magenta maroon=ff34b3 mediumorchid=e066ff mediumpurple=ab82ff mistyrose "
    "navajowhite olivedrab=c0ff3e orange orangered orchid=ff83fa palegreen=9aff9a paleturquoise=bbffff palevioletred=ff82ab peachpuff "
    "pink=ffb5c5 plum=ffbbff purple=9b30ff red rosybrown=ffc1c1 royalblue=4876ff salmon=ff8c69 seagreen=54ff9f seashell sienna=ff8247 "
    "skyblue=87ceff slateblue=836fff slategray=c6e2ff snow springgreen steelblue=63b8ff tan=ffa54f thistle=ffe1ff tomato turquoise=00f5ff "
    "violetred=ff3e96 wheat=ffe7ba yellow"
)
#: The share of the first shade's channels that the second, third and fourth have.
_SHADES = (0.932, 0.804, 0.545)


def _palette() -> dict[str, tuple[int, int, int]]:
    """Base names; then shades and 101 grays, which follow by rule. `grey` is `gray` in every name."""
    of = lambda h: tuple(int(h[i : i + 2], 16) for i in (0, 2, 4))
    words = _BASE.split()
    out = {n: of(h) for n, h in zip(words[::2], words[1::2], strict=True)}
    for family in _FAMILIES.split():
        name, _, first = family.partition("=")
        top = of(first) if first else out[name]
        for i, share in enumerate((1.0, *_SHADES)):
            out[f"{name}{i + 1}"] = tuple(int(share * c + 0.5) for c in top)
    out |= {f"gray{i}": (int(i * 2.55 + 0.5),) * 3 for i in range(101)}
    return out | {n.replace("gray", "grey"): v for n, v in out.items() if "gray" in n}


NAMED = _palette()
_VALID = "^#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"


def hex_of(rgb: tuple[int, int, int]) -> str:
    return "#{:02x}{:02x}{:02x}".format(*rgb)


def valid(color: Column) -> Column:
    return color.rlike(_VALID)


def _hex(color: Column) -> Column:
    """A name's hexadecimal form, a code in lower case, and null for anything else."""
    names = F.split(F.lit(",".join(NAMED)), ",")  # folded to constants, as are the codes
    codes = F.split(F.lit(",".join(map(hex_of, NAMED.values()))), ",")
    low = F.lower(color)
    return F.when(valid(color), low).otherwise(F.get(codes, F.nullif(F.array_position(names, low), F.lit(0)).cast("int") - 1))


def rgb(color: Column) -> Column:
    """`#rrggbb`, without alpha."""
    return F.substring(_hex(color), 1, 7)


def rgba(color: Column) -> Column:
    """`#rrggbbaa`; opaque where no alpha is given."""
    h = _hex(color)
    return F.when(F.length(h) == 9, h).otherwise(F.concat(h, F.lit("ff")))


def channel(color: Column, i: int) -> Column:
    """0 red, 1 green, 2 blue, as an integer."""
    return F.conv(F.substring(rgb(color), 2 + 2 * i, 2), 16, 10).cast("int")


def brightness(color: Column) -> Column:
    return (channel(color, 0) + channel(color, 1) + channel(color, 2)) / F.lit(3.0)


def ruler(background: Column) -> Column:
    """Black or white, whichever contrasts more; black on a tie."""
    b = brightness(background)
    return F.when(255.0 - b > b, F.lit("#ffffff")).otherwise(F.lit("#000000"))


def luma(color: Column) -> Column:
    """Gray level by the Rec. 709 weights, half to even."""
    return F.rint(0.2126 * channel(color, 0) + 0.7152 * channel(color, 1) + 0.0722 * channel(color, 2)).cast("int")


def flatten(value: Column, alpha: Column) -> Column:
    """A channel of a pixel laid over white; alpha is 0 to 1."""
    return F.rint(alpha * value + (1 - alpha) * 255).cast("int")


def channels_of(color: str) -> tuple[int, int, int]:
    """Red, green and blue of a code or name, on the driver."""
    code = color[1:7] if color.startswith("#") else hex_of(NAMED[color.lower()])[1:]
    return int(code[:2], 16), int(code[2:4], 16), int(code[4:], 16)


def nearest(colors: DataFrame, column: str, palette: list[tuple[str, str]], out: str) -> DataFrame:
    """The palette entry (name, colour) nearest to each colour by squared distance of the channels; the first of equals.
    Each distinct colour looks through the palette, a list of the caller's, in one expression."""
    split = lambda values: F.split(F.lit(",".join(map(str, values))), ",")  # noqa: E731  folded into a constant
    names, sides = split([n for n, _ in palette]), [split([channels_of(c)[i] for _, c in palette]).cast("array<int>") for i in range(3)]
    found = colors.select(column).distinct()
    own = [F.col(f"_c{i}") for i in range(3)]
    found = found.select(column, *[channel(F.col(column), i).alias(f"_c{i}") for i in range(3)])
    apart = lambda at: sum(((F.get(s, at) - c) * (F.get(s, at) - c) for s, c in zip(sides[1:], own[1:], strict=True)), (F.get(sides[0], at) - own[0]) * (F.get(sides[0], at) - own[0]))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(palette) - 1)), lambda at: F.struct(apart(at).alias("d"), at.alias("at"))))
    return colors.join(found.select(column, F.get(names, best.getField("at")).alias(out)), column, "left")


def counts(pixels: DataFrame, wanted: list[str]) -> DataFrame:
    """Pixels of each listed colour per image, zero where absent, in the caller's order."""
    spark = pixels.sparkSession
    asked = spark.createDataFrame([(i, c) for i, c in enumerate(wanted)], "ord int, asked string").withColumn("color", rgb(F.col("asked")))
    found = pixels.groupBy("image_id", rgb(F.col("color")).alias("color")).agg(F.count(F.lit(1)).alias("n"))
    every = pixels.select("image_id").distinct().crossJoin(F.broadcast(asked))
    return every.join(found, ["image_id", "color"], "left").select("image_id", "ord", "color", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def most_frequent(pixels: DataFrame, column: str = "color", out: str = "background") -> DataFrame:
    """The most frequent colour of each image; the lowest of equals. Counts are combined before the exchange."""
    n = pixels.groupBy("image_id", column).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("image_id").agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(out))
