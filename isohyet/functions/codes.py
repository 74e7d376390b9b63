"""Observation elements, report types, quality codes and physical constants (fixed values)."""

# name, raw id, localization class
ELEMENTS = (
    ("U", 2819, "WND"), ("V", 2820, "WND"), ("T", 3073, "T"), ("Tv", 3074, "T"),
    ("Q", 3330, "MOI"), ("RH", 3331, "MOI"), ("PS", 14593, "PS"), ("PRC", 19999, "PRC"),
    ("REF", 4001, "REF"), ("RE0", 4004, "REF"), ("Vr", 4002, "Vr"), ("PRH", 4003, "REF"),
    ("H08", 8800, "H08"), ("TCX", 99991, "TCV"), ("TCY", 99992, "TCV"), ("TCP", 99993, "TCV"),
)
ID = {name: raw for name, raw, _ in ELEMENTS}
CLASS_OF = {raw: cls for _, raw, cls in ELEMENTS}
RADAR_TYPE = 22

GOOD, GROSS_ERROR, TERRAIN, REF_LOW, REF_MEMBERS = 0, 5, 10, 11, 12
ABOVE_RADAR, ABOVE_MODEL, BELOW_MODEL, BAD_OBS = 19, 20, 21, 50
UNUSED, OUT_OF_TIME, OUT_OF_DOMAIN, UNDEFINED = 90, 97, 98, 99

PI = 3.1415926535
GRAVITY = 9.81
R_DRY = 287.05
R_VAPOUR = 461.50
CP_DRY = 1005.7
EARTH_RADIUS = 6371300.0
