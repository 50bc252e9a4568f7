"""Column lists and enumerations of the retention data model."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Column names, value lists and lookup tables that have to agree
# with the source data and with the published feature definitions.
# ---------------------------------------------------------------------------

NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

WON, CHURNED, OPEN = "Won", "Churned", "Open"
DECIDED = [WON, CHURNED]
EMAIL_WINDOWS = ["prior_year", "45_out", "14_out", "pre_renewal"]

BAND_ORDER = {
    "Group": 0, "Band A": 1, "Band B": 2, "Band C1": 3, "Band C2": 4, "Band D": 5, "Band E": 6,
    "Band F": 7, "Band F1": 8, "Band F2": 9, "Band G": 10, "Band H": 11, "Band I": 12, "Band J": 13,
}

AUTO_RENEWAL_YES = ["y", "Y", "yes"]
AUTO_RENEWAL_NO = ["n", "N", "no"]
# accepted in addition when the lenient reading is asked for
AUTO_RENEWAL_YES_LENIENT = ["Yes", "YES"]
AUTO_RENEWAL_NO_LENIENT = ["No", "NO"]

FLAG_YES = ["yes", "y", "true", "1"]
FLAG_NO = ["no", "n", "false", "0"]
FLAG_NOT_DISCUSSED = ["not discussed", "not applicable"]
EXTRACT_NULL = ["not applicable", "not discussed", "unavailable", "xxxx", ""]
EXTRACT_NO = ["no", "[no]", "**no**"]

CALL_SENTIMENTS = ["Satisfied", "Neutral", "Dissatisfied", "Not Discussed"]
EMAIL_SENTIMENT = {
    "satisfied": "Positive",
    "positive": "Positive",
    "neutral": "Neutral",
    "not discussed": "Neutral",
    "dissatisfied": "Negative",
    "negative": "Negative",
    "initially dissatisfied, later neutral": "Neutral",
    "initially dissatisfied, later satisfied": "Positive",
}
DIRECTIONS = {
    "outbound": "Outbound", "out_bound": "Outbound", "inbound": "Inbound", "in_bound": "Inbound",
}

# Shapes of readable dates; the last group of the first two is the time of day.
DAY_FIRST_SHAPE = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})($|[ T].*$)"
YEAR_FIRST_SLASHES = r"^(\d{4})/(\d{1,2})/(\d{1,2})($|[ T].*$)"
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
NAMED_MONTH_SHAPE = r"^\d{1,2}[ -]+[A-Za-z]{3}[ -]+\d{4}$"

BILLING_DATES = [
    "Prospect_Renewal_Date", "Closed_Date", "Registration_Date", "Proforma_Date", "DateTime_Out",
]
BILLING_NUMBERS = [
    "Discount_Amount", "Total_Net_Paid", "Last_Total_Net_Paid", "Amount", "Total_Amount",
    "Payment_Timeframe", "Tenure_Years", "Connection_Net", "Connection_Qty", "Last_Years_Date_Paid",
    "Current_Anchorings", "Auto_Renewal_Score", "Renewal_Score_At_Release", "Sustainability_Score",
    "#_of_Connection", "Total_Renewal_Score_New", "Status_Scores", "Tenure_Scores",
]
BILLING_TEXT = [
    "Prospect_Outcome", "Band", "Last_Band", "Current_Auto_Renewal_Flag", "Payment_Method",
    "Current_World_Pay_Token", "Renewal_Month",
]
BILLING_KEEP = [
    "Co_Ref", "Renewal_Year", "Band", "Tenure_Years", "Current_Anchorings", "Connection_Qty",
    "Discount_Amount", "Last_Total_Net_Paid", "Current_Auto_Renewal_Flag", "Auto_Renewal_Score",
    "Renewal_Score_At_Release", "Sustainability_Score", "Last_Band", "Prospect_Outcome",
    "#_of_Connection", "Prospect_Renewal_Date", "Closed_Date",
]
DROP_BEFORE_TRAINING = [
    "Co_Ref", "Renewal_Year", "Prospect_Outcome", "outcome_post_renewal", "churn_label", "Band",
    "Current_Auto_Renewal_Flag", "Last_Band", "Current_Anchor_List", "Prospect_Status",
    "Prospect_Renewal_Date", "Closed_Date",
]
DROP_BEFORE_SAVE = [
    "Renewal_Year", "Prospect_Outcome", "outcome_post_renewal", "Band", "Payment_Method",
    "Current_Auto_Renewal_Flag", "Last_Band", "tenure_bucket", "flag_bucket", "Current_Anchor_List",
    "Prospect_Status", "Connection_Group", "Tenure_Group", "Anchor_Group", "Proforma_Account_Stage",
    "Proforma_Audit_Status", "Proforma_Membership_Status", "Proforma_Approved_Lists", "DateTime_Out",
    "Last_Years_Date_Paid", "Proforma_Date", "Closed_Date", "Registration_Date",
    "Prospect_Renewal_Date", "Renewal_Month", "_closed_within_4w", "Last_Renewal",
]
LEAKAGE = [
    "Membership_Renewal_Decision", "Churn_Category", "Desire_To_Cancel",
    "Customer_Renewal_Response_Category",
]

CC_SCORES = [
    "cc_contractor_sentiment_start_score", "cc_contractor_sentiment_end_score",
    "cc_contractor_sentiment_overall_score", "cc_contractor_sentiment_issues_score",
]
CC_FLAGS = [
    "cc_care_package", "cc_care_package_discussed", "cc_urgency_getting_on_site",
    "cc_external_consultant", "cc_agent_cross_sell_attempt", "cc_customer_issues_concerns",
    "cc_business_struggles_financial_hardship", "cc_chasing_response",
    "cc_issues_within_questionnaire", "cc_login_issues", "cc_platform_issues",
    "cc_dissatisfaction_time_to_complete", "cc_process_complexity_concerns",
    "cc_questions_harder_than_expected", "cc_dissatisfaction_support", "cc_pricing_mentioned",
    "cc_pricing_sentiment_impact", "cc_refund_discussed", "cc_contractor_suggest_leave",
    "cc_contractor_complained",
]
EMAIL_FLAGS = [
    "crm_accreditation_completed", "crm_timely_completion", "crm_progress_towards_accreditation",
    "crm_delays_in_accreditation", "crm_contractor_suggested_leave", "crm_contractor_engagement",
    "crm_dts_or_ssip_mentioned", "crm_customer_payment_intention", "crm_competitors_mentioned",
    "crm_platform_issues_raised", "crm_agent_chased_contractor", "crm_accreditation_issues",
    "crm_membership_overdue", "crm_auto_renewal_status", "crm_dissatisified_with_renewal_price",
    "crm_customer_complained", "crm_refund_mentioned", "crm_negative_customer_experience",
    "crm_dissatisfaction_with_support", "crm_financial_hardship_mentioned",
]
RC_FLAGS = [
    "Discussion_on_Price_Increase", "Renewal_Impact_Due_to_Price_Increase",
    "Discount_or_Waiver_Requested", "Call_Reschedule_Request",
    "Agent_Flagged_Membership_Status_Alert", "Agent_Renewal_Initiation",
    "Explicit_Competitor_Mention", "Explicit_Switching_Intent", "Price_Switching_Mentioned",
    "Competitor_Value_Comparison", "Competitor_Benefits_Mentioned",
    "Percentage_Price_Increase_Mentioned", "Monetary_Price_Increase_Mentioned",
    "Price_Range_Mentioned", "Customer_Asked_For_Justification", "Discount_Offered",
    "Serious_Complaint", "Other_Complaint",
]
RC_TEXT = [
    "Complaint_Category", "Mentioned_Competitors", "Customer_Response",
    "Agent_Renewal_Pitch_Category", "Agent_Response_Category", "Agent_Response_To_Cancel_Category",
    "Justification_Category", "Reason_For_Renewal_Category",
    "Argument_That_Convinced_Customer_to_Stay_Category",
]

# feature name -> call column that has to say Yes on at least one call
CC_EVER = {
    "cc_ever_suggest_leave": "cc_contractor_suggest_leave",
    "cc_ever_hardship": "cc_business_struggles_financial_hardship",
    "cc_ever_complained": "cc_contractor_complained",
    "cc_ever_platform_issues": "cc_platform_issues",
    "cc_ever_login_issues": "cc_login_issues",
    "cc_ever_pricing": "cc_pricing_mentioned",
    "cc_ever_refund": "cc_refund_discussed",
}
RC_EVER = {
    "rc_discount_requested": "Discount_or_Waiver_Requested",
    "rc_price_discussed": "Discussion_on_Price_Increase",
    "rc_competitor_mentioned": "Explicit_Competitor_Mention",
    "rc_switching_intent": "Explicit_Switching_Intent",
    "rc_rescheduled": "Call_Reschedule_Request",
    "rc_agent_flagged": "Agent_Flagged_Membership_Status_Alert",
    "rc_price_switching": "Price_Switching_Mentioned",
    "rc_asked_justification": "Customer_Asked_For_Justification",
    "rc_discount_offered": "Discount_Offered",
}
EMAIL_EVER = {
    "email_ever_suggested_leave": "crm_contractor_suggested_leave",
    "email_ever_competitor_mentioned": "crm_competitors_mentioned",
    "email_ever_price_dissatisfied": "crm_dissatisified_with_renewal_price",
    "email_ever_complained": "crm_customer_complained",
    "email_ever_financial_hardship": "crm_financial_hardship_mentioned",
    "email_ever_refund_mentioned": "crm_refund_mentioned",
    "email_ever_membership_overdue": "crm_membership_overdue",
    "email_ever_negative_experience": "crm_negative_customer_experience",
}
NEGATIVE_FLAGS = [
    "cc_ever_suggest_leave", "cc_ever_hardship", "cc_ever_complained", "cc_ever_platform_issues",
    "cc_ever_pricing", "rc_discount_requested", "rc_competitor_mentioned", "rc_switching_intent",
    "rc_rescheduled", "rc_agent_flagged", "auto_renewal_off", "anchoring_zero",
]
NEGATIVE_FLAGS_PROFILING = NEGATIVE_FLAGS + ["payment_unknown", "price_increase_10pct"]

DEFAULT_PARAMS = {
    "n_estimators": 400, "max_depth": 5, "learning_rate": 0.04, "subsample": 0.8,
    "colsample": 0.8, "min_child": 5, "gamma": 0.1, "pos_weight": 9.5, "seed": 42,
}
TUNED_PARAMS = {
    "n_estimators": 600, "max_depth": 3, "learning_rate": 0.03, "subsample": 0.8,
    "colsample": 0.8, "min_child": 5, "gamma": 0.1, "pos_weight": 5.0, "seed": 42,
}
SWEEP_WEIGHTS = [5.0, 7.0, 9.5, 12.0, 15.0]
SWEEP_DEPTHS = [3, 4, 5, 6, 7]
SWEEP_RATES = [
    {"learning_rate": 0.10, "n_estimators": 200},
    {"learning_rate": 0.05, "n_estimators": 400},
    {"learning_rate": 0.03, "n_estimators": 600},
    {"learning_rate": 0.01, "n_estimators": 1000},
]

# (id, feature, kind); features that a table does not have are skipped
HYPOTHESES = [
    ("H1", "anchoring_zero", "Chi-square"),
    ("H2", "auto_renewal_off", "Chi-square"),
    ("H3", "price_increase_10pct", "Chi-square"),
    ("H4", "any_leave_signal", "Chi-square"),
    ("H5", "any_competitor_signal", "Chi-square"),
    ("H7", "payment_unknown", "Chi-square"),
    ("H6", "Tenure_Years", "Mann-Whitney"),
    ("H8", "email_pct_negative", "Mann-Whitney"),
    ("H9", "total_negative_flags", "Mann-Whitney"),
]
#: Tested columns that the model table leaves out.
PROFILING_TESTED, EMAIL_TESTED = ["price_increase_10pct", "payment_unknown"], ["email_pct_negative"]
SUMMARY_HEADERS = {
    "hypothesis": "Hypothesis", "feature": "Feature", "test": "Test", "p_value": "p-value",
    "effect_size": "Effect Size", "churn_if_0": "Churn if 0", "churn_if_1": "Churn if 1",
    "lift": "Lift (1 vs 0)", "significant": "Significant", "mean_retained": "Mean Retained",
    "mean_churned": "Mean Churned",
}
SIGNIFICANT_MARK, NOT_SIGNIFICANT_MARK, NO_LIFT = "✓", "✗", "N/A"
PREDICTION_CONTEXT = [
    "Band", "Tenure_Years", "Current_Anchorings", "auto_renewal_off", "payment_unknown",
]

# ---------------------------------------------------------------------------
# Derived lists
# ---------------------------------------------------------------------------

BILLING_COLUMNS = ["Co_Ref", "Renewal_Year", *BILLING_TEXT, *BILLING_DATES, *BILLING_NUMBERS]
CC_COLUMNS = [
    "Co_Ref", "Contact_ID", "Call_Date", "Call_Year", "Direction", "cc_contractor_sentiment",
    *CC_SCORES, *CC_FLAGS,
]
EMAIL_COLUMNS = [
    "Co_Ref", "year", "Time_to_Renewal", "crm_contractor_sentiment",
    "crm_contractor_sentiment_score", "crm_agent_chase_count", *EMAIL_FLAGS,
]
RC_COLUMNS = [
    "Co_Ref", "Call_Date", "Call_Year", "Call_Number", "Call_Direction",
    *RC_FLAGS, *LEAKAGE, *RC_TEXT,
]
TABLES = {
    "billings": BILLING_COLUMNS,
    "cc_calls": CC_COLUMNS,
    "emails": EMAIL_COLUMNS,
    "renewal_calls": RC_COLUMNS,
}
