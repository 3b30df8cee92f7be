"""Schemas of the inputs. Extracts are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the lab extract, in file order, all text.
LAB_COLUMNS = """
ActualFasting Addendum approvalstatus assignedToId Billable billClient billType cancelled ccresulttolist
ccResultToListIds clinicalinfo collDate collDescription collSource collTime collUnits collVolume commonNotesFlag
deleteFlag displayIndex dtEmailSent emailSent EncounterId fasting fromLabId futureflag FutureOrderDate HasACopy
hl7id1 hl7id2 hl7id3 HMFlag IntNotes ItemId labrefid newcol Notes OBFLabType ordencounterid OrderInstructions
ordPhyId ordPhyName patientIdentifier performedby PregId prevencounterid priority profileID PSEHold
publishToPortal reason received refPhyFlag ReportId result ResultDate resultime resultSentStatus ResultStatus
ReviewedBy ReviewedDate ReviewedTime SendVmsg status tolabid transDate transTime Type vmid websync
""".split()

# Columns of the document extract, in file order, all text.
DOCUMENT_COLUMNS = """
attachto claimRef consentDocEHX customName delFlag Description dirpath doc_Type docID documentheight documentwidth
drawingid eHXSentStatus encId expiresuppress expirydate FacilityId fileformat filename folderName ftpserver
injuryId insuranceid migrateflag modifieddatetime oldfilename pagecount PatientId pnCatId pnItemId portalboxUpload
Priority proxyuid publishToEHX refId refReqId refType resolution Review ReviewerId reviewername scanbyid scanDate
ScannedBy servicedate sizeinbytes source suggestedpatients TempDocId tocId uniqueDocId wcReportTypeCode websync
""".split()

# Columns of the external document report.
REPORT_COLUMNS = ["Document ID", "Reviewed Date", "Scanned By", "Reviewer Name", "Patient Acct No + Name"]

# Columns of the booking invoices.
INVOICE_COLUMNS = ["PatientDateOfBirth", "AppointmentTime", "BookingTime", "PatientEmail", "PatientFirstName",
                   "PatientLastName", "Premium"]


def all_text(columns: list[str]) -> T.StructType:
    """The raw layer: every column a nullable text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


LABS = all_text(LAB_COLUMNS)
DOCUMENTS = all_text(DOCUMENT_COLUMNS)
DOCUMENT_REPORT = all_text(REPORT_COLUMNS)
BOOKING_INVOICES = all_text(INVOICE_COLUMNS)


# Typed inputs, as DDL.
VISITS = (
    "patient_id long, encounter_id long, appointment_date date, facility_group_id long, is_new_patient int, "
    "general_visit_status_id int, np_flag int, visit_status string, visit_type string"
)
CLAIMS = (
    "claim_no long, patient_id long, primary_insurance_id long, facility_group_id long, resource_provider_id long, "
    "visit_type_id long, service_date date, calendar_week_id long, is_billable int, new_patient int, "
    "payment decimal(18,2), complexity_level string"
)
PROCEDURES = CLAIMS + ", cpt_id long, cpt_provider_allocated_id long"
FACILITY_GROUP = "facility_group_id long, facility_group_name string"
PRIMARY_INSURANCE = (
    "primary_insurance_id long, primary_insurance_class string, primary_insurance_group string, primary_insurance_name string"
)
CALENDAR_WEEK = "calendar_week_id long, calendar_period string, calendar_week string, calendar_year string"
RESOURCE_PROVIDER = "resource_provider_id long, resource_provider_name string"
VISIT_TYPE = "visit_type_id long, visit_type string, visit_type_description string"
CPT = "cpt_id long, cpt_group string, cpt_description string"
FISCAL_CALENDAR = "dates date, period string"
CLAIMS_WITH_CPT = (
    "claim_no long, encounter_id long, patient_id long, resource_provider_name string, payer_class string, "
    "quality_level string, service_date date"
)
CLAIMS_WITHOUT_CPT = (
    "claim_no long, encounter_id long, patient_id long, resource_provider_name string, quality_level string, "
    "visit_type_classification string, service_date date, payment decimal(18,2), billed_charge decimal(18,2)"
)
APPLIED_REVENUE = (
    "claim_no long, encounter_id long, payment decimal(18,2), service_date date, deposit_date date"
)
ENCOUNTERS = "encounter_id long, visit_status string, appointment_provider_name string, appointment_date date"
BOOKING_LOG = (
    "patient_id long, encounter_id long, appointment_date date, modify_date timestamp_ntz, log_details string"
)
