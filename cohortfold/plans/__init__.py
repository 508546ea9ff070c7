"""Criteria trees and the cohort job."""
