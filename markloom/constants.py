"""Fixed values. They must equal the published rules, so they stand here as plain text."""

# outcomes of a checklist question (fixed values)
NOT_REVIEWED = ["Not Reviewed", "Not observed or not recorded", "Not observed or recorded"]
NOT_ASSESSED = "Not Assessed"
BLANK = ["None", ""]
POSITIVE = ["Yes", "Completed"]
NEGATIVE = ["No", "Not completed"]

# score weights (fixed values)
NA_WEIGHT = 0.5
CHECKLIST_WEIGHT = 0.8
RUBRIC_WEIGHT = 0.2
PENALTY_20 = 0.8
PENALTY_10 = 0.9
EPSILON_SCORE = 0.0001
EPSILON_PATIENTS = 0.00001

# rubric scales: weight and denominator per setting (fixed values)
RUBRICS = ["PS", "CS", "TS", "ES"]
RUBRIC_SETTINGS = [
    ("Simulation", "PS", 0.05, 2),
    ("Simulation", "CS", 0.05, 2),
    ("Simulation", "TS", 0.1, 4),
    ("Simulation", "ES", 0.1, 4),
    ("Clinic", "PS", 0.1, 4),
    ("Clinic", "CS", 0.1, 4),
    ("Clinic", "TS", 0.1, 4),
    ("Clinic", "ES", 0.1, 4),
]
RUBRIC_SCALE_NAMES = {
    "Professionalism Scale": "PS",
    "Communication Scale": "CS",
    "Time Management Scale": "TS",
    "Entrustment Scale": "ES",
}

# checklist names in headers (fixed values)
CHECKLIST_HEADERS = {
    "Positioning": "PEC",
    "Infection control": "ICC",
    "Record keeping": "RKC",
    "Consent": "CC",
    "Anatomy": "ANATOMY",
    "Additional items": "ADD_ITEMS",
}
CHECKLIST_TITLES = {
    "Positioning and Ergonomics Checklist": "PEC",
    "Infection control Checklist": "ICC",
    "Record keeping Checklist": "RKC",
    "Consent Checklist": "CC",
}
TAG_CORRECTIONS = {"INFIL": "INFILTRATION", "CINIC": "CLINIC"}
ROLE_NUMBERS = {"1": "student", "2": "supervisor"}

# pairs of service columns merged into one (fixed values)
SERVICE_MERGES = [
    ("Prevention CLINIC", "Prevention SIM", "Preventive, Prophylactic and Bleaching Services"),
    ("Perio CLINIC", "Perio SIM", "Periodontics"),
    ("Endo SIM", "Endo CLINIC", "Endodontics"),
    ("Resto CLINIC", "Resto SIM", "Restorative Services"),
    ("Fixed Pros Clinic", "Fixed Pros SIM", "Fixed Prosthodontics"),
]

# tooth names to the standard tooth, first match wins (fixed values)
STANDARD_TEETH = [
    ("premolar", "24"),
    ("incisor", "11"),
    ("24", "24"),
    ("11", "11"),
    ("21", "11"),
    ("25", "24"),
    ("45", "24"),
]

# weights of the items of a tooth (fixed values)
TOOTH_ITEM_WEIGHTS = [
    ("11", "415_SIM ACCESS", 0.4),
    ("11", "415_SIM WORK LENGTH", 0.2),
    ("11", "417_SIM CONE FIT", 0.2),
    ("11", "417_SIM ROOT FLG", 0.2),
    ("24", "415_SIM ACCESS", 0.4),
    ("24", "415_SIM WORK LENGTH", 0.1),
    ("24", "416_SIM", 0.1),
    ("24", "417_SIM CONE FIT", 0.1),
    ("24", "417_SIM ROOT FLG", 0.1),
    ("24", "418_SIM CONE FIT", 0.1),
    ("24", "418_SIM ROOT FLG", 0.1),
]

# competency phrases to levels; None is "not observed" (fixed values)
COMPETENCY_LEVELS = {
    "Able to perform task/s independently": 4,
    "Able to perform task/s under my indirect supervision": 3,
    "Able to perform task/s under my direct/proactive supervision": 2,
    "Not yet able to perform task/s": 1,
    "Not yet able to perform task/s.": 1,
    "Not yet able to perform task/s. Critical concern": 1,
    "Not observed": None,
    "Competent/Independent": 4,
    "Developing competency/Indirect supervision required": 3,
    "Dependent/Close supervision required": 2,
    "Not yet competent/Critical concerns": 1,
    "I am able to perform this task independently": 4,
    "I am able to perform this task with indirect/limited supervision": 3,
    "I am able to perform this task with direct/close supervision": 2,
    "I am not yet able to perform this task": 1,
    "I am not yet able to perform this task.": 1,
    "I did not have to perform that task today": None,
    "I did not have to perform that task today.": None,
}

# importance bands: name, lowest weight, highest weight (fixed values)
IMPORTANCE_BANDS = [("critical", 10, 10), ("important", 7, 9), ("moderate", 4, 6), ("minor", 1, 3)]

# ages: name of the band, lowest age, highest age (fixed values)
AGE_BANDS = [("0-6", 0, 6), ("7-17", 7, 17), ("18+", 18, 139)]

# words counted as praise or criticism in a remark (a list of our own, small by design)
POLARITY_WORDS = {
    "good": 1.0, "great": 1.0, "excellent": 1.0, "well": 0.5, "clear": 0.5, "careful": 0.5,
    "poor": -1.0, "bad": -1.0, "late": -0.5, "unsafe": -1.0, "not": -0.5, "unclear": -0.5,
}
