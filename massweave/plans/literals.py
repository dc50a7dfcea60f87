"""Tables and word lists the results depend on."""

# Ordered classification rules (text looked at, pattern, label).
# "both" is "<domain> <component>"; the first match wins, the rest are VCC.
CLASSIFICATION_RULES = [
    ("both", r"battery management system|bms|master bms|slave bms", "BMS"),
    ("component", r"^bms|battery.*management", "BMS"),
    ("domain", r"^hv\s*power", "PE_HVS"),
    ("both", r"traction inverter|main.*inverter|rear.*inverter|front.*inverter|e-axle.*inverter", "PE_HVS"),
    ("both", r"traction battery|traction.*pack|high voltage battery|hv.*battery", "PE_HVS"),
    ("both", r"dc/dc|dc-dc converter|hv-lv.*converter|high voltage.*converter", "PE_HVS"),
    ("both", r"onboard charger|obc|charging inlet|charge port|charging.*control|charging.*system", "PE_HVS"),
    ("both", r"dc fast.*charge|fast.*charge.*interface|external.*charge|rapid.*charge", "PE_HVS"),
    ("both", r"hv junction|hv distribution|hv.*pdu|hv.*power distribution", "PE_HVS"),
    ("both", r"isolation monitoring|hv.*fuse|hv.*contactor|hv.*interlock|hv.*relay", "PE_HVS"),
    ("both", r"power.*modul|powermodul|power.*unit", "PE_HVS"),
    ("both", r"12v.*battery|12 v.*battery|auxiliary battery|auxilary battery|aux.*battery", "PE_HVS"),
    ("both", r"front.*power distribution|rear.*power distribution|power distribution unit", "PE_HVS"),
    ("domain", r"^thermal$", "PE_HVS"),
    ("both", r"thermal.*management|coolant.*pump|thermal.*ecu|thermal.*system|thermal.*control", "PE_HVS"),
    ("both", r"battery.*cooling|inverter.*cooling|motor.*cooling|hv.*cooling", "PE_HVS"),
    ("both", r"chiller|heat exchanger|cooling.*valve|thermal.*valve", "PE_HVS"),
    ("both", r"heater|ptc.*heater|battery.*heater|cabin.*heater|coolant.*heater|high voltage.*heater", "PE_HVS"),
    ("both", r"high voltage|hv.*system", "PE_HVS"),
    ("both", r"seat heater", "PE_HVS"),
    ("domain", r"^lighting$", "MLIS"),
    ("both", r"headlamp|headlight|lamp.*control|led.*driver", "MLIS"),
    ("both", r"adaptive.*light|matrix.*light|matrix.*beam", "MLIS"),
    ("both", r"interior.*lighting|ambient.*light|illumination", "MLIS"),
    ("both", r"tail.*light|brake.*light|turn.*signal|fog.*light", "MLIS"),
    ("domain", r"^infotainment$", "ITC"),
    ("both", r"head unit|infotainment.*system|center.*display|multimedia", "ITC"),
    ("both", r"audio.*amplifier|radio|tuner|speaker", "ITC"),
    ("domain", r"^connectivity$", "ITC"),
    ("both", r"telematics|tcu|modem|wifi|bluetooth|v2x|antenna", "ITC"),
    ("domain", r"^hmi$", "ITC"),
    ("both", r"instrument cluster|digital.*cluster|head-up display|hud", "ITC"),
    ("both", r"touchscreen|display.*controller", "ITC"),
    ("domain", r"^networking$", "ITC"),
    ("both", r"gateway|ethernet.*switch|can.*gateway|network.*controller", "ITC"),
    ("domain", r"^diagnostics$", "ITC"),
    ("both", r"obd|diagnostic", "ITC"),
    ("domain", r"^data\s*logging$", "ITC"),
    ("both", r"data.*logging|data.*recorder", "ITC"),
    ("both", r"keyless.*entry|passive.*entry", "ITC"),
    ("both", r"event data recorder", "ITC"),
    ("domain", r"^adas$", "SSS"),
    ("both", r"camera|radar|lidar|ultrasonic.*sensor|parking.*sensor", "SSS"),
    ("both", r"parking assist|driver monitoring", "SSS"),
    ("domain", r"^safety$", "SSS"),
    ("both", r"airbag|restraint|occupant.*detection|crash.*sensor", "SSS"),
    ("domain", r"^security$", "SSS"),
    ("both", r"alarm|anti-theft|immobilizer", "SSS"),
    ("domain", r"^brakes$", "SSS"),
    ("both", r"abs|esc|esp|brake.*control|ebcm|brake-by-wire", "SSS"),
    ("both", r"adas.*ecu|adas.*controller|adas.*domain|adas.*computer|fusion.*ecu|automated driving", "VCC"),
]
CLASSIFICATION_DEFAULT = "VCC"

# States and tiers, in order.
ARCH_STATES = ["Conventional", "Transitional", "SDV_Zonal"]
TIERS = ["H0", "H1", "H2", "H3", "H4"]
SENSOR_TYPES = ["camera", "radar", "lidar", "ultrasonic"]

# Tier shares per segment and anchor year, H0..H4.
TIER_SHARES = {
    "EF": {2025: (0.00, 0.10, 0.25, 0.62, 0.03), 2030: (0.00, 0.05, 0.15, 0.60, 0.20),
           2035: (0.00, 0.00, 0.10, 0.45, 0.45), 2040: (0.00, 0.00, 0.05, 0.40, 0.55),
           2050: (0.00, 0.00, 0.00, 0.35, 0.65), 2060: (0.00, 0.00, 0.00, 0.35, 0.65),
           2070: (0.00, 0.00, 0.00, 0.35, 0.65)},
    "CD": {2025: (0.10, 0.45, 0.35, 0.10, 0.00), 2030: (0.05, 0.25, 0.40, 0.28, 0.02),
           2035: (0.00, 0.10, 0.30, 0.45, 0.15), 2040: (0.00, 0.05, 0.20, 0.50, 0.25),
           2050: (0.00, 0.00, 0.10, 0.50, 0.40), 2060: (0.00, 0.00, 0.10, 0.50, 0.40),
           2070: (0.00, 0.00, 0.10, 0.50, 0.40)},
    "AB": {2025: (0.45, 0.45, 0.10, 0.00, 0.00), 2030: (0.25, 0.45, 0.25, 0.05, 0.00),
           2035: (0.10, 0.35, 0.40, 0.15, 0.00), 2040: (0.05, 0.25, 0.40, 0.28, 0.02),
           2050: (0.00, 0.10, 0.30, 0.45, 0.15), 2060: (0.00, 0.10, 0.30, 0.45, 0.15),
           2070: (0.00, 0.10, 0.30, 0.45, 0.15)},
}

# Ranging sensors carried at each tier.
TIER_RANGING = {"H0": 1.0, "H1": 2.0, "H2": 4.0, "H3": 5.3, "H4": 7.0}

# Sensors carried per segment and tier,
# (camera min, max, radar min, max, ultrasonic min, max, lidar min, max).
TIER_COUNTS = {
    ("AB", "H0"): (2, 3, 1, 1, 1, 3, 0, 0), ("AB", "H1"): (2, 4, 1, 3, 3, 8, 0, 0),
    ("AB", "H2"): (4, 6, 2, 5, 4, 8, 0, 0), ("AB", "H3"): (5, 6, 3, 5, 4, 8, 0, 1),
    ("AB", "H4"): (5, 6, 3, 5, 4, 8, 1, 3),
    ("CD", "H0"): (2, 5, 1, 1, 2, 3, 0, 0), ("CD", "H1"): (2, 7, 1, 3, 7, 9, 0, 0),
    ("CD", "H2"): (4, 10, 2, 5, 8, 10, 0, 0), ("CD", "H3"): (5, 10, 3, 5, 8, 10, 0, 1),
    ("CD", "H4"): (5, 10, 3, 5, 8, 10, 1, 3),
    ("EF", "H0"): (2, 5, 1, 1, 2, 4, 0, 0), ("EF", "H1"): (4, 7, 2, 3, 7, 11, 0, 0),
    ("EF", "H2"): (7, 10, 4, 5, 8, 12, 0, 0), ("EF", "H3"): (8, 11, 5, 5, 8, 12, 0, 1),
    ("EF", "H4"): (8, 11, 5, 5, 8, 12, 1, 3),
}
TIER_COUNT_TYPES = ("camera", "radar", "ultrasonic", "lidar")

# Lidar-equipped share, (year, min, mode, max).
LIDAR_SHARE = [
    (2025, 0.00, 0.01, 0.02), (2030, 0.03, 0.12, 0.30), (2035, 0.08, 0.28, 0.55), (2040, 0.12, 0.45, 0.70),
    (2050, 0.18, 0.60, 0.85), (2060, 0.22, 0.66, 0.88), (2070, 0.25, 0.70, 0.90),
]
LIDAR_H4_FLOOR = 0.80

# Presence of a component at each tier; text marks another driver.
PRESENCE_PER_TIER = [
    ("Front ADAS camera", "1.00", "1.00", "1.00", "1.00", "1.00"),
    ("Rear view camera", "0.50", "0.90", "1.00", "1.00", "1.00"),
    ("Side / mirror cameras", "0.00", "0.25", "0.80", "1.00", "1.00"),
    ("Front long-range radar", "1.00", "1.00", "1.00", "1.00", "1.00"),
    ("Corner short/mid-range radars", "0.00", "0.30", "0.85", "1.00", "1.00"),
    ("LiDAR sensor", "0.00", "0.00", "0.00", "Driver B", "Driver B"),
    ("Ultrasonic sensors", "0.30", "0.90", "1.00", "1.00", "1.00"),
    ("Driver monitoring camera", "0.20", "0.50", "0.90", "1.00", "1.00"),
    ("ADAS camera ECU (basic)", "1.00", "1.00", "0.50", "0.20", "0.10"),
    ("ADAS domain controller / fusion ECU", "0.00", "0.10", "0.70", "1.00", "1.00"),
    ("Automated driving central computer", "0.00", "0.00", "0.10", "0.50", "1.00"),
    ("Parking assist ECU", "0.20", "0.80", "1.00", "1.00", "1.00"),
]

# Scenario multipliers at the anchor years, and weights.
SCENARIO_YEARS = (2040, 2050, 2060, 2070)
SCENARIOS = {
    "S1": ((1.00, 1.00, 1.00, 1.00), 0.25),
    "S2": ((1.00, 1.15, 1.28, 1.40), 0.50),
    "S3": ((1.00, 1.35, 1.70, 2.00), 0.25),
}
SCENARIO_START_YEAR = 2040

# Presence of a component in each architecture state.
ARCH_PRESENCE = {
    "Body Control Module (BCM)": (1.0, 1.0, 0.0),
    "Powertrain domain controller": (0.0, 1.0, 0.0),
    "Chassis domain controller": (0.0, 1.0, 0.0),
    "Body/comfort domain controller": (0.0, 1.0, 0.0),
    "Zone controller (front/rear/etc.)": (0.0, 0.0, 1.0),
    "Automated driving central computer": (0.0, 0.0, 1.0),
    "ABS/ESC control module (EBCM)": (1.0, 1.0, 1.0),
    "ADAS domain controller / fusion ECU": (0.0, 1.0, 1.0),
}
SCALE_RESOLUTION = 0.15

# Label level and the interval it stands for.
LABEL_BINS = {1.00: (0.750, 1.000), 0.50: (0.375, 0.750), 0.25: (0.125, 0.375), 0.00: (0.000, 0.125)}

# Model constants.
HV_CU_REDUCTION = (0.40, 0.425, 0.45)
ZONAL_METRES = (0.85, 0.875, 0.90)
HEIGHT_ADDER = (0.05, 0.10, 0.15)
CV_VEHICLE = 0.10
CV_CATEGORY = 0.175
VARIABILITY_FLOOR = 0.05
TIMING_SPREAD_Y = 5.0
MOTOR_TAU_Y = (20.0, 30.0, 50.0)
N_FINE_BINS = 1000
N_COARSE_BINS = 50
PILOT_PAD = 0.35

# Grade weights.
STEEL_WEIGHTS = {
    "AB": {"M19": 1 / 3, "M27": 1 / 3, "M43": 1 / 3},
    "CD": {"M19": 2 / 5, "M27": 2 / 5, "M43": 1 / 5},
    "EF": {"M19": 1 / 2, "M27": 1 / 2},
}
COPPER_WEIGHTS = {"ETP": 1 / 3, "OF": 1 / 3, "OFE": 1 / 3}
MAGNET_WEIGHTS = {
    "small": {
        "AB": {"N35": 1 / 3, "N42": 1 / 3, "N48": 1 / 3},
        "CD": {"N35": 1 / 2, "N42": 1 / 2},
        "EF": {"N42": 1 / 2, "N48": 1 / 2},
    },
    "medium": {
        "AB": {"N40": 0.20, "N42": 0.20, "N45": 0.20, "N48": 0.20,
               "N35SH": 0.05, "N42SH": 0.05, "N45SH": 0.05, "N48SH": 0.05},
        "CD": {"N40": 0.075, "N42": 0.075, "N45": 0.075, "N48": 0.075,
               "N35SH": 0.075, "N42SH": 0.075, "N45SH": 0.075, "N48SH": 0.075,
               "N40UH": 0.10, "N42UH": 0.10, "N45UH": 0.10},
        "EF": {"N35SH": 0.075, "N42SH": 0.075, "N45SH": 0.075, "N48SH": 0.075,
               "N40UH": 0.10, "N42UH": 0.10, "N45UH": 0.10, "N40EH": 0.15, "N42EH": 0.15},
    },
}
