"""Types and fixed values of the profile engine."""

from __future__ import annotations

EXPERIENCE = "struct<company: string, title: string, start: string, end: string, summary: string>"
EDUCATION = "struct<institution: string, degree: string, field: string, end_year: int>"
#: One row per extracted value: (file_seq, claim_seq) is its place in the input, which settles ties; file_seq is the name of its file.
CLAIMS = f"entity_key string, file_seq string, claim_seq int, path string, v string, exp {EXPERIENCE}, edu {EDUCATION}, source string, method string, fuzzy boolean"
WARNINGS = "entity_key string, file_seq string, file string, warning string"

# Fixed values of the domain: trust of sources and of unknown ones, in ten-thousandths.
TRUST = {"ats_json": 9000, "recruiter_csv": 8500, "resume": 6000, "github": 5000, "recruiter_notes": 3500}
UNKNOWN_TRUST = 3000
#: Added for each corroborating source, at most so many; discount and bounds, in ten-thousandths.
STEP, CAP, LOW, HIGH = 500, 3, 500, 9900
FUZZY_METHODS = ("regex", "heuristic", "fuzzy")
SCALARS = ("full_name", "headline", "years_experience", "location.city", "location.region", "location.country", "links.linkedin", "links.github", "links.portfolio")
LISTS = ("emails", "phones", "links.other")
#: Weight of each confidence group, in the order in which groups are summed.
IMPORTANCE = {"full_name": 3.0, "headline": 1.0, "years_experience": 1.5, "location": 1.5, "links": 0.5, "emails": 3.0, "phones": 3.0, "skills": 1.0, "experience": 1.5, "education": 1.0}
