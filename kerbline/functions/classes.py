"""Sign classes: labels, shapes, sizes and codes. Shapes and widths are rules; codes are a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes in metres.
DEFAULT, WARNING, LARGE, SMALL = 0.60, 0.70, 0.90, 0.40

#: Class name and its traffic-code entry in the map export.
MAP_CODES = """
warning--roadworks DE:123
warning--roundabout DE:215
warning--road-bump DE:138
warning--uneven-road DE:112
warning--slippery-road-surface DE:114
warning--curve-right DE:105
warning--curve-left DE:105
warning--double-curve-first-right DE:107
warning--double-curve-first-left DE:107
warning--pedestrians-crossing DE:101
warning--children DE:136
warning--crossroads DE:102
warning--junction-with-a-side-road-perpendicular-right DE:102
warning--junction-with-a-side-road-perpendicular-left DE:102
warning--road-narrows DE:120
warning--road-narrows-right DE:121
warning--road-narrows-left DE:122
warning--other-danger DE:101
warning--traffic-signals DE:131
warning--railroad-crossing-with-barriers DE:150
warning--railroad-crossing-without-barriers DE:151
warning--falling-rocks-or-debris-right DE:125
warning--falling-rocks-or-debris-left DE:125
warning--wild-animals DE:142
warning--domestic-animals DE:145
warning--traffic-merges-right DE:123
warning--traffic-merges-left DE:123
warning--road-slope-right DE:108
warning--road-slope-left DE:108
warning--road-dip DE:112
warning--bicycles-crossing DE:138
warning--delineator DE:625
warning--delineator--right DE:625-10
warning--delineator--left DE:625-20
regulatory--no-entry DE:267
regulatory--no-parking DE:286
regulatory--no-right-turn DE:267
regulatory--no-left-turn DE:267
regulatory--no-overtaking DE:276
regulatory--no-u-turn DE:272
regulatory--no-bicycles DE:254
regulatory--no-pedestrians DE:259
regulatory--no-motor-vehicles DE:251
regulatory--no-buses DE:257
regulatory--no-goods-vehicles DE:253
regulatory--no-goods-vehicles-exceeding-limit DE:253
regulatory--no-heavy-goods-vehicles DE:253
regulatory--maximum-speed-limit DE:274
regulatory--height-limit DE:265
regulatory--weight-limit DE:263
regulatory--axel-mass-limit DE:263
regulatory--keep-right DE:222
regulatory--keep-left DE:222
regulatory--go-straight DE:209
regulatory--turn-right DE:211
regulatory--turn-left DE:211
regulatory--go-straight-or-turn-right DE:214
regulatory--go-straight-or-turn-left DE:214
regulatory--turn-left-or-right DE:214
regulatory--pass-on-either-side DE:222
regulatory--bicycles-only DE:237
regulatory--pedestrians-only DE:239
regulatory--shared-path-pedestrians-and-bicycles DE:240
regulatory--roundabout DE:215
regulatory--yield DE:205
regulatory--yield-to-oncoming-traffic DE:208
regulatory--stop DE:206
information--parking DE:314
information--hospital DE:358
information--gas-station DE:365
information--motorway DE:330
information--disabled-persons DE:314
information--tram-bus-stop DE:224
complementary--chevron-left DE:625-20
complementary--chevron-right DE:625-10
complementary--distance DE:1004
"""

#: Sign numbers of the point-cloud labels, and entries that only the sprite labels have.
LABEL_NUMBERS = """
regulatory--no-entry 267
regulatory--stop 206
regulatory--yield 205
regulatory--maximum-speed-limit 274
regulatory--no-u-turn 272
regulatory--no-overtaking 276
regulatory--no-parking 286
regulatory--height-limit 265
regulatory--weight-limit 263
regulatory--go-straight 209
regulatory--keep-right 222
regulatory--keep-left 222
warning--crossroads 102
warning--curve-right 103
warning--curve-left 103
warning--roundabout 215
warning--roadworks 123
warning--children 136
warning--pedestrians-crossing 133
warning--slippery-road-surface 114
warning--traffic-signals 131
warning--railroad-crossing-with-barriers 151
warning--railroad-crossing-without-barriers 150
information--parking 314
information--hospital 358
information--motorway 330
information--gas-station 361
"""
SPRITE_NUMBERS = """
regulatory--no-right-turn 267
regulatory--no-left-turn 267
regulatory--turn-right 209
regulatory--turn-left 209
"""
#: Codes of unknown classes in the two outputs.
UNKNOWN_CODE, UNKNOWN_NUMBER = "DE:999", "???"


def _pairs(text: str) -> dict[str, str]:
    return dict(line.split() for line in text.strip().splitlines())


def sign_classes(spark: SparkSession) -> DataFrame:
    """class, map_code, label_number, sprite_number; 76 rows."""
    label, sprite = _pairs(LABEL_NUMBERS), _pairs(LABEL_NUMBERS) | _pairs(SPRITE_NUMBERS)
    rows = [(c, code, label.get(c, UNKNOWN_NUMBER), sprite.get(c, UNKNOWN_NUMBER)) for c, code in _pairs(MAP_CODES).items()]
    return spark.createDataFrame(rows, "class string, map_code string, label_number string, sprite_number string")


def label(c: Column) -> Column:
    """Upper-case words after the first double dash."""
    return F.upper(F.replace(F.regexp_replace(c, "^.*?--", ""), F.lit("-"), F.lit(" ")))


def shape(c: Column) -> Column:
    return (
        F.when(c.startswith("regulatory--no-") | c.startswith("regulatory--maximum-speed"), "prohibitory")
        .when(c.startswith("regulatory--yield"), "yield")
        .when(c.startswith("regulatory--stop"), "stop")
        .when(c.startswith("regulatory--"), "mandatory")
        .when(c.startswith("warning--"), "danger")
        .when(c.startswith("information--"), "info")
        .when(c.startswith("complementary--"), "complementary")
        .otherwise("other")
    )


def nominal_size(c: Column) -> Column:
    """Size by shape, as the sprites use it."""
    s = shape(c)
    large_info = (s == "info") & c.rlike("motorway|hospital")
    return F.when(s.isin("stop", "yield") | large_info, LARGE).when(s == "danger", WARNING).otherwise(DEFAULT)


#: Real widths in metres of classes that are not of the usual 0.60.
WIDTHS = {
    0.90: ["regulatory--yield", "regulatory--yield-to-oncoming-traffic", "regulatory--stop"],
    0.70: """regulatory--height-limit regulatory--weight-limit regulatory--axel-mass-limit warning--roadworks warning--roundabout warning--road-bump
warning--uneven-road warning--slippery-road-surface warning--curve-right warning--curve-left warning--double-curve-first-right warning--double-curve-first-left
warning--pedestrians-crossing warning--children warning--crossroads warning--junction-with-a-side-road-perpendicular-right
warning--junction-with-a-side-road-perpendicular-left warning--road-narrows warning--road-narrows-right warning--road-narrows-left warning--other-danger
warning--traffic-signals warning--railroad-crossing-with-barriers warning--railroad-crossing-without-barriers warning--falling-rocks-or-debris-right
warning--falling-rocks-or-debris-left warning--wild-animals warning--domestic-animals warning--traffic-merges-right warning--traffic-merges-left
warning--road-slope-right warning--road-slope-left warning--road-dip warning--bicycles-crossing""".split(),
    0.40: "warning--delineator warning--delineator--right warning--delineator--left complementary--chevron-left complementary--chevron-right complementary--distance".split(),
}


def real_width(c: Column) -> Column:
    """Width for distances from single images; 0.60 for all classes that are not listed, unknown ones too."""
    out = F.lit(DEFAULT)
    for width, names in WIDTHS.items():
        out = F.when(c.isin(*names), width).otherwise(out)
    return out


def is_triangular(c: Column) -> Column:
    return c.startswith("warning--")


def is_circular(c: Column) -> Column:
    return c.startswith("regulatory--") & ~c.rlike("^regulatory--(stop|yield|yield-to-oncoming-traffic)$")


def tag_text(code: Column, name: Column, confidence: Column, kind: Column) -> Column:
    """Text of a hover tag."""
    sign = F.when(code.isNotNull(), name).when(confidence >= 0.5, F.concat(name, F.lit(" (REVIEW)"))).otherwise("Sign")
    return F.when(kind == "light", "Traffic Light").otherwise(sign)
