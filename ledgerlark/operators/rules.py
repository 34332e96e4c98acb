"""Fixed rule tables. Values that must be as they are for right results, in their order of precedence."""

from __future__ import annotations

#: The subcommittee of a division title, by the first text that it contains.
JURISDICTIONS = [
    ("department of defense", "defense"),
    ("defense appropriations", "defense"),
    ("departments of labor", "labor_hhs"),
    ("labor, health", "labor_hhs"),
    ("transportation, housing and urban development", "thud"),
    ("transportation-housing", "thud"),
    ("financial services", "financial_services"),
    ("general government", "financial_services"),
    ("commerce, justice, science", "cjs"),
    ("science, and related agencies", "cjs"),
    ("energy and water", "energy_water"),
    ("interior, environment", "interior"),
    ("department of the interior", "interior"),
    ("agriculture, rural development", "agriculture"),
    ("legislative branch", "legislative_branch"),
    ("military construction, veterans", "milcon_va"),
    ("military construction and veterans", "milcon_va"),
    ("state, foreign", "state_foreign_ops"),
    ("department of state", "state_foreign_ops"),
    ("homeland security", "homeland_security"),
    ("continuing appropriations", "continuing_resolution"),
    ("further additional continuing", "continuing_resolution"),
    ("additional continuing", "continuing_resolution"),
    ("further continuing", "continuing_resolution"),
    ("extension of continuing", "continuing_resolution"),
    ("other matters", "other"),
    ("miscellaneous", "other"),
    ("budgetary effects", "budget_process"),
    ("extensions", "extenders"),
    ("extender", "extenders"),
    ("health care extender", "extenders"),
]

#: Jurisdictions that are no subcommittee of their own.
NOT_SUBCOMMITTEES = ["continuing_resolution", "extenders", "policy", "budget_process", "other"]

#: Three-digit agency codes by agency name, in order of precedence for partial matches.
AGENCY_CODES = [
    ("department of homeland security", "070"),
    ("department of defense", "097"),
    ("department of veterans affairs", "036"),
    ("department of transportation", "069"),
    ("department of housing and urban development", "086"),
    ("department of agriculture", "012"),
    ("department of health and human services", "075"),
    ("department of justice", "015"),
    ("department of state", "019"),
    ("department of the interior", "014"),
    ("department of energy", "089"),
    ("department of the treasury", "020"),
    ("department of labor", "016"),
    ("department of education", "091"),
    ("department of commerce", "013"),
    ("environmental protection agency", "068"),
    ("national aeronautics and space administration", "080"),
    ("national science foundation", "049"),
    ("small business administration", "073"),
    ("general services administration", "047"),
    ("office of personnel management", "024"),
    ("social security administration", "028"),
    ("nuclear regulatory commission", "031"),
    ("agency for international development", "072"),
    ("executive office of the president", "011"),
    ("the judiciary", "010"),
    ("department of the army", "021"),
    ("department of the navy", "017"),
    ("department of the air force", "057"),
    ("corps of engineers", "096"),
    ("federal emergency management agency", "070"),
    ("u.s. customs and border protection", "070"),
    ("u.s. immigration and customs enforcement", "070"),
    ("transportation security administration", "070"),
    ("coast guard", "070"),
    ("united states secret service", "070"),
    ("cybersecurity and infrastructure security agency", "070"),
    ("federal law enforcement training centers", "070"),
    ("countering weapons of mass destruction office", "070"),
    ("national institutes of health", "075"),
    ("centers for disease control and prevention", "075"),
    ("food and drug administration", "075"),
    ("health resources and services administration", "075"),
    ("substance abuse and mental health services administration", "075"),
    ("indian health service", "075"),
    ("administration for children and families", "075"),
    ("centers for medicare and medicaid services", "075"),
    ("centers for medicare & medicaid services", "075"),
    ("forest service", "012"),
    ("natural resources conservation service", "012"),
    ("farm service agency", "012"),
    ("food and nutrition service", "012"),
    ("animal and plant health inspection service", "012"),
    ("agricultural research service", "012"),
    ("bureau of land management", "014"),
    ("national park service", "014"),
    ("u.s. fish and wildlife service", "014"),
    ("fish and wildlife service", "014"),
    ("bureau of reclamation", "014"),
    ("bureau of indian affairs", "014"),
    ("u.s. geological survey", "014"),
    ("federal bureau of investigation", "015"),
    ("drug enforcement administration", "015"),
    ("bureau of alcohol, tobacco, firearms and explosives", "015"),
    ("federal bureau of prisons", "015"),
    ("u.s. marshals service", "015"),
    ("national oceanic and atmospheric administration", "013"),
    ("national institute of standards and technology", "013"),
    ("federal highway administration", "069"),
    ("federal aviation administration", "069"),
    ("federal transit administration", "069"),
    ("federal railroad administration", "069"),
    ("national highway traffic safety administration", "069"),
    ("maritime administration", "069"),
]

#: Service branches by what an account's name contains, for defence agencies; otherwise 097.
BRANCH_CODES = [(", army", "021"), ("army national guard", "021"), ("army reserve", "021"), (", navy", "017"), ("marine corps", "017"), ("navy reserve", "017"), (", air force", "057"), ("air national guard", "057"), ("air force reserve", "057"), ("space force", "057")]
