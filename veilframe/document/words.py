"""Titles, name shapes and word lists of the detection rules, in their published order."""

from __future__ import annotations

# Titles, shapes of name tokens and particles.
TITLES = (
    r"(?:Mr|Mrs|Ms|Miss|Mx|Mstr|Master|Dr|Doctor|Prof|Professor|A/Prof|Assoc(?:iate)?\.?[ \t]+Prof(?:essor)?"
    r"|Sir|Dame|Rev|Reverend|Fr|Father|Sr|Sister|Br|Brother|Hon|Judge|Justice|Magistrate|Commissioner"
    r"|Coroner|Registrar|Arbitrator|Senior[ \t]+Member|Conciliator|Mediator)"
)
NAME_TOKEN = (
    r"(?:(?:Mc|Mac|O['’]|D['’])[A-Z][a-z]+|[A-Z][a-z]+(?:[-'’][A-Z]?[a-z]+)*"
    r"|[A-Z]{2,}(?:[-'’][A-Z]+)*|[A-Z]\.?)"
)
PARTICLE = r"(?:van|von|de|der|den|del|della|di|da|du|dos|das|la|le|bin|binti|ibn|al|el|ter|ten)"
EDGES = ',;:()[]{}"“”'
MALE_TITLES = frozenset("mr master mstr sir fr father br brother".split())
FEMALE_TITLES = frozenset("mrs ms miss dame sr sister".split())
PROFESSIONAL_TITLES = frozenset("dr doctor prof professor a/prof assoc associate".split())

# Capitalised words that are no part of a name.
NON_NAMES = frozenset(
    """the and of in on at to for with from by re dear yours regards report hospital clinic medical centre
    center pty ltd limited group services service health department court tribunal commission insurance
    lawyers solicitors partners associates practice surgery specialist specialists rooms street road
    avenue drive please thank thanks kind sincerely faithfully copy cc encl attachment page date claim
    policy reference ref number no patient claimant worker doctor sir madam colleague team manager officer
    re: mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday january
    february march april june july august september october november december he she they his her
    their it this that these those i we you our your was were is are has have had not no yes also
    today yesterday tomorrow medicare centrelink nsw vic qld sa wa tas nt act australia australian""".split()
)
POST_NOMINALS = frozenset(
    """fracs fracp franzcp fafom fafrm facsep frcs frcp mbbs mbchb mb bs md phd dphil bsc bmedsc bappsc
    mphty mpsych mclinpsych franzcr fanzca fracgp facrrm facem franzcog fcicm dipmsm oam am ao ac qc sc
    kc llb llm ba ma msc faortha faps maps fama gaicd bphty bphysio dpt boccthy bpsych mba jp rn en""".split()
)
MEDICAL = frozenset(
    """ot pt gp ct mr mri ed icu gcs bp hr rr ecg eeg emg ncs xr us dvt pe mi cva tia copd ckd af iv im sc
    po pr prn bd tds qid nbm rom wpi ama dass ptsd mdd gad ocd adhd asd tbi loc nad sob rsi crps""".split()
)
LABEL_WORDS = frozenset(
    """dob d.o.b urn mrn ur dva tfn abn acn crn ndis ihi hpi ahpra mcn nok id no ref attn ph mob
    tel fax email cc bcc aka nee c/o re dod""".split()
)
CLINICAL_NOUNS = frozenset(
    """sign signs test tests fracture fractures disease syndrome manoeuvre maneuver classification score scale
    criteria procedure operation approach lesion neuroma cyst contracture palsy phenomenon reflex view node
    angle index questionnaire inventory grade grading stage staging""".split()
)
PUBLIC_BODIES = frozenset(
    """medicare centrelink servicesaustralia ndis ndia sira icare worksafe worksafevictoria workcover
    workcoverqueensland workcoversa returntoworksa comcare tac transportaccidentcommission dva
    departmentofveteransaffairs ahpra ama racgp racs racp tga pbs mbs ato australiantaxationoffice
    nswhealth queenslandhealth sahealth wahealth departmentofhealth personalinjurycommission
    workerscompensationcommission ncat vcat qcat aat administrativeappealstribunal fairworkcommission
    highcourt federalcourt supremecourt districtcourt countycourt magistratescourt localcourt
    federalcircuitcourt coronerscourt nswpolice victoriapolice queenslandpolice""".split()
)
DOSE_WORDS = frozenset(
    """forte plus extra osteo duo mite rapid max sr cr xr er mr cd la odt mg mcg microgram micrograms tablet
    tablets tabs capsule capsules caps patch patches gel cream injection injections syrup liquid drops spray
    inhaler suppository suppositories sachet sachets ampoule""".split()
)

# States, their short forms and first postcode digits, capitals and street types.
STATES = (
    r"(?:NSW|VIC|QLD|SA|WA|TAS|NT|ACT|N\.S\.W\.?|Vic\.?|Qld\.?|Tas\.?|New[ \t]+South[ \t]+Wales|Victoria"
    r"|Queensland|South[ \t]+Australia|Western[ \t]+Australia|Tasmania|Northern[ \t]+Territory"
    r"|Australian[ \t]+Capital[ \t]+Territory)"
)
STATE_NAMES = {
    "nsw": "NSW", "n.s.w": "NSW", "new south wales": "NSW", "vic": "VIC", "victoria": "VIC", "qld": "QLD", "queensland": "QLD", "sa": "SA",
    "south australia": "SA", "wa": "WA", "western australia": "WA", "tas": "TAS", "tasmania": "TAS", "nt": "NT", "northern territory": "NT",
    "act": "ACT", "australian capital territory": "ACT",
}
POSTCODE_LEADS = {"NSW": "2", "ACT": "2", "VIC": "3", "QLD": "4", "SA": "5", "WA": "6", "TAS": "7", "NT": "0"}
CAPITAL_CITIES = frozenset("sydney melbourne brisbane perth adelaide hobart darwin canberra".split())
PLACES = CAPITAL_CITIES | frozenset(
    "australia newsouthwales victoria queensland southaustralia westernaustralia tasmania northernterritory australiancapitalterritory nsw vic qld sa wa tas nt act newzealand".split()
)
STREET_TYPES = (
    "Street St Road Rd Avenue Ave Av Drive Dr Court Ct Place Pl Crescent Cres Cr Lane Ln Way Parade "
    "Pde Terrace Tce Boulevard Boulevarde Blvd Bvd Highway Hwy Close Cl Circuit Cct Grove Gr Gve Square "
    "Sq Esplanade Esp Track Trail Rise Row Mews Walk Loop Link Vista View Glade Gardens Gdns Heights "
    "Hts Ridge Promenade Quay Alley Arcade Bend Brace Chase Concourse Corso Cove Crest Cross Dell "
    "Entrance Gate Grange Green Hill Junction Landing Mall Meander Nook Outlook Pass Path Pathway "
    "Point Reserve Retreat Round Strip Turn Vale Wharf Circle Plaza Parkway Freeway Motorway"
).split()
STREET_WORDS = frozenset(w.lower() for w in STREET_TYPES)
UNIT_WORDS = frozenset("unit apt apartment flat suite shop level lvl lot u po p.o p.o. box gpo locked private bag pmb rmb rsd cmb".split())

# Words of roles.
PROFESSIONS = (
    r"(?i)\b(?:surgeon|orthopaedic|orthopedic|psychiatrist|psychologist|physiotherapist|physio|practitioner|"
    r"radiologist|neurologist|neurosurgeon|rheumatologist|anaesthetist|physician|specialist|consultant|"
    r"registrar|occupational[ \t]+therapist|nurse|clinician|solicitor|lawyer|barrister|counsel|paralegal|"
    r"case[ \t]+manager|claims?[ \t]+(?:officer|manager|consultant)|rehabilitation[ \t]+(?:provider|consultant)|"
    r"assessor|examiner|treating)\b"
)
SUBJECTS = (
    r"(?i)(?:\bre:|\bre\b[ \t]*-|\bpatient\b|\bclaimant\b|\bworker\b|\binjured\b|\bapplicant\b|\bplaintiff\b|"
    r"\bdeceased\b|\bclient\b|\bour[ \t]+client\b|\bwife\b|\bhusband\b|\bpartner\b|\bspouse\b|\bson\b|"
    r"\bdaughter\b|\bmother\b|\bfather\b|\bbrother\b|\bsister\b|\bchild(?:ren)?\b|\bde[ \t]+facto\b|"
    r"\bfianc[eé]e?\b|\bgrand(?:son|daughter|mother|father|child)\b|\bnephew\b|\bniece\b|\bfriend\b|"
    r"\bwitness\b|\bd\.?o\.?b\b|date[ \t]+of[ \t]+birth|\bborn\b|\baddress\b|\bresides\b|\blives\b)"
)

# Names that are also medical terms, and medicines, as far as the public rules' tests ask for them.
EPONYMS = frozenset(
    """adson allen apley achilles baker barthel beck bell berg bouchard boutonniere charcot colles cozen crohn cushing dupuytren
    finkelstein froment galeazzi gerber glasgow hawkins heberden hoffa hoffmann horner huntington jobe jones kienbock kohler lachman
    lisfranc luria maisonneuve mcmurray monteggia morton neer oswestry osgood paget parkinson patrick phalen pott quervain raynaud
    reiter romberg rorschach scheuermann schlatter schober smith speed spurling sudeck thessaly thomas thompson tinel trendelenburg
    watson wechsler weber yergason""".split()
)
DRUGS = frozenset(
    """panadol panadeine paracetamol codeine ibuprofen nurofen voltaren diclofenac naproxen celebrex celecoxib meloxicam mobic tramadol tramal
    targin oxycontin oxycodone endone palexia tapentadol morphine norspan buprenorphine fentanyl lyrica pregabalin gabapentin neurontin endep
    amitriptyline cymbalta duloxetine sertraline zoloft fluoxetine escitalopram lexapro mirtazapine venlafaxine efexor quetiapine seroquel
    diazepam valium temazepam zolpidem stilnox metformin atorvastatin perindopril""".split()
)
# Types that are implausible without a digit.
NEEDS_DIGIT = frozenset(
    """medicare ihi hpi tfn crn ndis dva_file passport driver_licence provider_number ahpra card_number bank_account abn acn vin vehicle_reg
    clinical_id court_file employee_id reference other_id phone ip_address postcode""".split()
)
