"""The sample entities of the tests, written to a folder: one directory an entity."""

from __future__ import annotations

import json
from pathlib import Path

#: Five sources that agree and differ: spelling of the name, titles of the present job, a skill that four sources name.
ADA = {
    "applicant.json": json.dumps({
        "fullName": "Ada QUILL-ROSS", "email": "ada@quill.example", "phone": "+44 20 7946 0018", "yearsOfExperience": 12, "locationCity": "Leeds", "locationState": "West Yorkshire", "locationCountry": "Great Britain",
        "portfolioUrl": "https://quill.example", "skills": ["py", "Kubernetes", "erlang"],
        "employmentHistory": [{"company": "Pinnace Ltd", "title": "Principal Engineer", "startDate": "04/2020", "endDate": "now"}, {"company": "Gannet", "title": "Developer", "startDate": "2013-09", "endDate": "2020-03"}],
        "schools": [{"institution": "Leeds", "degree": "BSc", "major": "Physics", "graduationYear": 2012}], "batch": 7, "Assessor": "x",
    }),
    "github_ada.json": json.dumps({"user": {"login": "adaq", "name": "Ada Quill-Ross", "bio": "Schedulers and queues", "location": "Leeds, UK", "html_url": "https://code.example/adaq", "blog": ""}, "languages": ["Erlang", "Python"]}),
    "call.txt": "Talked on Monday; about 12 years in the field.\nStrong in Python and Erlang.\nWrite to ada@quill.example.\n",
    "export.csv": "Candidate,Email_Address,Cell,Employer,Job_Title\nAda Quill-Ross,ADA@quill.example,+44 (20) 7946 0018,Pinnace Ltd,Principal Engineer\n",
    "resume.md": "Ada Quill-Ross\nada@quill.example · +44 20 7946 0018\n\nProfile\nEngineer of schedulers   and queues.\n\nCore Skills:\nPython, Erlang, Terraform\n\nEmployment\nPrincipal Engineer at Pinnace Ltd   Apr 2020 - Present\n\nAcademic Background\nUniversity College, BA 2012\n",
}
#: No address anywhere; a country that is guessed.
BO = {
    "ats.json": json.dumps({"candidateName": "bo lindqvist", "mobile": "+31 20 555 0134", "locationCountry": "the netherlands"}),
    "notes.txt": "~4 yrs so far. Proficient in TypeScript, CSS.\nOnly the number +31 20 555 0134 is known.\n",
}
#: A file that breaks off and one that is empty: the others carry the entity.
CHIDI = {
    "ats.json": '{"fullName": "Chidi Okoro", "skills": ["Go"',
    "empty.csv": "",
    "notes.txt": "Referral. 8 years of experience with Kafka; mail chidi@okoro.example.\n",
    "resume.txt": "Chidi Okoro\nchidi@okoro.example\n\nSkills\nGo, Kafka\n\nExperience\nBackend Engineer at Tern Pay   Jan 2019 - Present\n",
}
#: Contacts and tools of others in projects and references, tiers of skills, dashes of two kinds.
DANA = {
    "resume.txt": "Dana Veres\ndana@veres.example | +1 (503) 555-0139\n\nSkills\nExpert: Java, SQL\nFamiliar: Rust | Flask\n\nExperience\nLead Developer at Osprey   June 2018 – Current\nMoved billing to events.\nPlover — Developer   2015/ - 2016\nDeveloper at Sandpiper   May 2014 to May 2018\n\nProjects\nParser — written in C++ with help of helper@other.example.\n\nEducation\nReed College, B.A. 2013\n\nReferences\nMo Tan, mo@tan.example, +1 (503) 555-0177\n",
}
ENTITIES = {"ada": ADA, "bo": BO, "chidi": CHIDI, "dana": DANA}


def write_samples(folder: Path) -> str:
    for entity, files in ENTITIES.items():
        (folder / entity).mkdir(parents=True)
        for name, text in files.items():
            (folder / entity / name).write_text(text, encoding="utf-8")
    return str(folder)
