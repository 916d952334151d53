"""Declared shapes of facts and dimensions."""

ASSESSMENT_FORM = """
assessment_id bigint, student_number bigint, student_name string, assessor_name string, date date,
cohort string, subject string, type string, student_role string, clinic_type string, patient_age int,
patient_drn string, patient_status string, teeth_quadrant_info string, student_submitted boolean,
assessor_submitted boolean, time_mgmt double, entrustment double, communication double,
professionalism double, assessor_feedback string, student_feedback string, patient_complexity string,
clinical_incident string, student_data map<string,string>, supervisor_data map<string,string>,
created_at timestamp
"""
ROSTER = "student_id bigint, cohort string, first_name string, surname string, email string"
QUESTION = "code string, tag string, qno bigint, full_text string"
WEIGHT = "item string, qno bigint, importance string, difficulty string, score_weight double, ebel_weight double"
CUTOFF = "item string, cutoff double"
