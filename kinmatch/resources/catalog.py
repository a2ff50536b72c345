"""The sports, in the order of reports. Key, id, spellings."""

from __future__ import annotations

SPORTS = (
    ("FUTBOL", "FOOTBALL", ("futbol", "soccer", "football")),
    ("BASKETBOL", "BASKETBALL", ("basketbol", "basketball")),
    ("VOLEYBOL", "VOLLEYBALL", ("voleybol", "volleyball")),
    ("TENIS", "TENNIS", ("tenis", "tennis")),
    ("MASA_TENISI", "TABLE_TENNIS", ("masa tenisi", "table tennis")),
    ("BUZ_HOKEYI", "ICE_HOCKEY", ("buz hokeyi", "ice hockey")),
    ("AMERIKAN_FUTBOLU", "AMERICAN_FOOTBALL", ("amerikan futbolu", "american football", "am football")),
    ("BEYZBOL", "BASEBALL", ("beyzbol", "baseball")),
    ("HENTBOL", "HANDBALL", ("hentbol", "handball")),
    ("RAGBI", "RUGBY", ("rugby", "ragbi", "rugby union", "rugby league")),
    ("KRIKET", "CRICKET", ("kriket", "cricket")),
    ("MMA", "MMA", ("mma", "mixed martial arts")),
    ("BOKS", "BOXING", ("boks", "boxing")),
    ("FORMULA_1", "FORMULA_1", ("formula 1", "formula one", "f1")),
    ("MOTOR_SPORLARI", "MOTORSPORT", ("araba yarislari", "auto racing", "motor racing", "motorsport", "nascar")),
    ("SALON_FUTBOLU", "FUTSAL", ("salon futbolu", "futsal")),
    ("SUTOPU", "WATER_POLO", ("sutopu", "water polo")),
    ("DART", "DARTS", ("dart", "darts")),
    ("SNOOKER", "SNOOKER", ("snooker", "bilardo")),
    ("GOLF", "GOLF", ("golf",)),
    ("SATRANC", "CHESS", ("santranc", "satranc", "chess")),
    ("BISIKLET", "CYCLING", ("bisiklet yarisi", "bisiklet", "cycling")),
    ("BIATLON", "BIATHLON", ("biatlon", "biathlon")),
    ("KAYAK", "SKIING", ("kayak", "alpine skiing", "cross country skiing", "ski jumping", "skiing")),
    ("AVUSTRALYA_FUTBOLU", "AUSTRALIAN_FOOTBALL", ("avustralya futbolu", "australian football", "aussie rules")),
    ("FLOORBALL", "FLOORBALL", ("floorball",)),
    ("GAELIC_FUTBOLU", "GAELIC_FOOTBALL", ("gaelic football",)),
    ("HURLING", "HURLING", ("hurling",)),
    ("BANDY", "BANDY", ("bandy", "ball hockey")),
    ("YELKEN", "SAILING", ("yelkencilik", "sailing", "yachting")),
    ("SORF", "SURFING", ("sorf", "surfing")),
    ("KABADDI", "KABADDI", ("kabaddi",)),
    ("SUMO", "SUMO", ("sumo",)),
    ("HALI_HOKEYI", "FIELD_HOCKEY", ("field hockey", "hali hokeyi")),
)

#: Sports that a nested document always has, even if empty.
LEGACY_KEYS = ("FUTBOL", "BASKETBOL", "VOLEYBOL", "TENIS")
UNKNOWN_SPORT, UNKNOWN_LEAGUE = "BILINMEYEN", "BILINMEYEN_LIG"
