"""Parameters with their defaults, and the fixed lists of the matcher."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

# Stop words of the matching step.
STOP_WORDS = (
    "grant", "grants", "funding", "award", "awards", "program", "programs", "project", "projects", "initiative", "initiatives", "center",
    "centers", "national", "federal", "support", "supporting", "research", "study", "studies", "analysis", "data", "methods",
    "methodology", "approach", "approaches", "process", "processes", "framework", "model", "models", "tool", "tools", "assessment",
    "evaluation", "measurement", "testing", "examining", "exploring", "identifying", "understanding", "evidence", "university", "science",
    "sciences", "medical", "medicine", "clinical", "patient", "patients", "human", "care", "health", "healthcare", "community",
    "communities", "population", "populations", "individual", "individuals", "family", "families", "provider", "providers", "workforce",
    "improving", "improvement", "advancing", "promoting", "reducing", "preventing", "prevention", "addressing", "enhancing",
    "strengthening", "increasing", "decreasing", "developing", "utilizing", "applying", "using", "based", "outcomes", "quality",
    "effectiveness", "excellence", "innovative", "innovation", "innovations", "integrated", "translational", "collaborative",
    "collaboration", "disease", "treatment", "conditions", "chronic", "education", "training", "intervention", "interventions", "service",
    "services", "delivery", "access", "equity", "disparities", "capacity", "building", "system", "systems", "practice", "practices",
    "policy", "policies", "management", "implementation", "development", "precision", "writing", "developmental",
)

# Words of notices and mechanisms, which say nothing about a topic.
ADMIN_WORDS = (
    "extension", "correction", "change", "continuation", "supplement", "revision", "existing", "competitive", "cooperative", "temporary",
    "urgent", "notice", "eligibility", "compliance", "reissuance", "reissue", "update", "amendment", "modification", "announcement",
    "award", "program", "agreement", "guide", "guidance", "guideline", "information", "instruction", "requirement", "application",
    "submission", "deadline", "receipt", "review", "accounts", "independence", "pathway", "americans", "opportunity", "initiative",
    "resource", "approach", "support", "mechanism",
)

# How titles of notices begin.
ADMIN_PREFIXES = (
    "notice of correction",
    "notice of change",
    "notice of update",
    "notice of reissuance",
    "notice of modification",
    "urgent competitive revision to existing",
    "notice of intent to publish",
    "notice regarding",
    "request for information",
)

# Terms of agencies that are always relevant.
AGENCY_ALLOW = (
    "nih", "national institutes of health", "national institute", "nci", "nhlbi", "nimh", "niaid", "niddk", "nigms", "ninds", "nidcr",
    "nichd", "nccih", "niehs", "nimhd", "niaaa", "nida", "ncats", "nhgri", "obssr", "orwh", "fogarty", "ncmhd", "ahrq",
    "agency for healthcare research", "cdc", "centers for disease control", "hrsa", "health resources and services", "fda",
    "food and drug administration", "samhsa", "substance abuse and mental health", "acl", "administration for community living", "cms",
    "centers for medicare", "va", "veterans affairs", "department of veterans", "dod", "department of defense", "cdmrp",
    "congressionally directed medical", "barda", "biomedical advanced research", "arpa-h", "arpa h",
    "advanced research projects agency for health", "darpa", "nsf", "hhmi", "howard hughes", "wellcome", "gates foundation", "gates",
    "american cancer society", "american heart association", "american diabetes association", "alzheimer", "parkinson",
    "multiple sclerosis", "march of dimes", "simons foundation", "burroughs wellcome", "doris duke", "pcori",
    "patient-centered outcomes research",
)

# Terms of agencies and titles that never are.
AGENCY_BLOCK = (
    "epa", "environmental protection", "usda", "department of agriculture", "agricultural", "dot", "department of transportation",
    "federal highway", "federal transit", "hud", "housing and urban development", "doe", "department of energy", "usgs",
    "geological survey", "noaa", "national oceanic", "oceanic and atmospheric", "nasa", "fema", "emergency management", "sba",
    "small business administration", "treasury", "department of treasury", "commerce", "labor", "department of labor", "education",
    "department of education", "interior", "department of interior", "wetland", "watershed", "estuary", "forestry", "fisheries",
    "rural development", "rural utilities", "arts", "national endowment for the arts", "humanities",
    "national endowment for the humanities",
)

# Vocabulary of which a text of an unknown agency must have a word; stems match as whole words only.
VOCABULARY = (
    r"cancer|tumor|carcinoma|oncol|leukemia|lymphoma|melanoma|alzheimer|dementia|parkinson|neurodegenerat|diabetes|diabetic|insulin|"
    r"glucose|metabolic|obesity|cardiovascular|cardiac|heart|coronary|hypertension|stroke|vascular|infection|infectious|pathogen|"
    r"bacterial|viral|fungal|antimicrobial|antibiotic|HIV|AIDS|tuberculosis|malaria|sepsis|pneumonia|influenza|COVID|autoimmune|immune|"
    r"immunolog|allerg|asthma|mental health|psychiatric|depression|anxiety|schizophrenia|bipolar|opioid|substance use|addiction|overdose|"
    r"kidney|renal|liver|hepat|pulmonary|lung|respiratory|neurolog|brain|spinal|cognitive|epilepsy|seizure|musculoskeletal|orthopedic|"
    r"arthritis|bone|reproductive|maternal|neonatal|pediatric|geriatric|dermatolog|skin|wound|genomic|genome|gene|genetic|DNA|RNA|protein|"
    r"molecular|cellular|stem cell|cell therap|regenerat|biomarker|diagnostic|imaging|MRI|CT scan|PET|ultrasound|pharmacol|drug|"
    r"therapeut|treatment|clinical trial|randomized|surgery|surgical|transplant|microbiome|microbiota|epidemiolog|cohort|longitudinal|"
    r"health disparit|health equit|oncolog|cardiology|neurology|gastroenterol|dermatolog|patholog|radiology|psychiatry|pediatrics|"
    r"geriatrics|nursing|pharmacy|dentistry|dental|hospital|clinic|patient care|medical center|health system"
)

# Titles of links that lead to no opportunity.
JUNK_EXACT = (
    "learn more", "read more", "see more", "view more", "show more", "view all", "see all", "browse all", "load more", "apply now",
    "apply here", "apply online", "sign up", "sign in", "log in", "register", "subscribe", "submit", "back to top", "skip to content",
    "skip to main content", "home", "menu", "close", "search", "share", "next", "previous", "back",
)
JUNK_PREFIXES = (
    "application guidelines", "application instructions", "guidelines and information", "meeting dates", "grants calendar",
    "grant calendar", "events calendar", "see new grantee", "tips for applicants", "grant recipients", "grant review process",
    "researcher & reviewer", "researchers & reviewers", "scientific advisory board", "advisory board members", "co-fund a grant",
    "hospital study accounts", "reach grant application guidelines", "award grant application guidelines", "grant agreement with",
    "crazy 8 grant agreement", "browse alsf funded", "genomic data sharing",
)
JUNK_PARTS = (
    "cookie policy", "privacy policy", "terms of use", "annual report", "press release", "newsletter signup", "board of directors",
    "staff directory",
)


@dataclass(frozen=True)
class Config:
    min_keyword_length: int = 4
    semantic_threshold: float = 0.40
    max_keyword_prevalence: float = 0.08
    min_confidence: int = 35
    max_matches: int = 50
    lone_keyword_confidence: int = 50
    min_vocabulary_hits: int = 1
    min_idf: float | None = None
    full_merge: bool = False
    history_rows: int = 5000
    seen_ids: int = 10_000
    embedding_version: int = 5
    stop_words: tuple[str, ...] = STOP_WORDS
    admin_words: tuple[str, ...] = ADMIN_WORDS
    recipients: tuple[str, ...] = field(default=())

    def with_env(self, env: Mapping[str, str] = os.environ, prefix: str = "QUILLMATCH_") -> Config:
        """Recipients and numbers from the environment; recipients are parted by commas, empty ones left out."""
        found = {}
        for name, kind in (("min_keyword_length", int), ("semantic_threshold", float), ("max_keyword_prevalence", float), ("min_confidence", int), ("max_matches", int)):
            if value := env.get(prefix + name.upper()):
                found[name] = kind(value)
        if value := env.get(prefix + "RECIPIENTS"):
            found["recipients"] = tuple(x.strip() for x in value.split(",") if x.strip())
        return replace(self, **found)
