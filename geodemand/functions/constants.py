"""Fixed values shared with the reference behaviour (thresholds, lookup tables, display settings)."""

# Matching thresholds (km, 0-100 scores).
COORD_MATCH_KM = 30.0
FUZZY_IN_BLOCK_SCORE = 85
STOP_COORD_MATCH_KM = 2.0
STOP_FUZZY_SCORE = 80

# Spatial feature parameters.
METRO_RADIUS_KM = 50.0
METRO_FALLBACK_KM = 100.0
MAJOR_CITY_POP = 500_000
NEARBY_RADIUS_KM = 80.0
LONG_ROUTE_KM = 500.0
WEIGHT_RADII_KM = (15,)
FACILITY_RADIUS_KM = 30.0

# Display / report settings.
SHAPE_DOWNSAMPLE = 6
RATIO_SEVERE = 0.33
RATIO_UNDERSERVED = 0.5
RATIO_BELOW_MODEL = 0.77
RATIO_WELL_MATCHED_MAX = 1.3
RATIO_SUPPRESSED = 0.7
SUPPRESSED_MAX_TRIPS = 14
TOP20_MIN_ACTUAL = 50_000
MARKER_RADIUS_MIN = 5
MARKER_RADIUS_MAX = 22

# State name -> postal code.
STATE_ABBR = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR",
    "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE",
    "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID",
    "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS",
    "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN",
    "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE",
    "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC",
    "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR",
    "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC",
    "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT",
    "Vermont": "VT", "Virginia": "VA", "Washington": "WA",
    "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
    "District of Columbia": "DC",
}
