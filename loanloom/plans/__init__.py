"""Feature plans per source table and the assembled applicant matrix."""
