"""Name -> report function. Entry names: survey ID in lower case and a slug."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsframe.plans import admin, basic, building_blocks as bb, crm, field_service as fs, qa, recon, stored
from opsframe.sources.tables import Tables

REPORTS: dict[str, Callable[[Tables], DataFrame]] = {
    "r1_candidates_with_all_skills": basic.r1_candidates_with_all_skills,
    "r2_unmatched": basic.r2_unmatched,
    "r3_driver_day": fs.r3_driver_day,
    "r3_driver_day_durations": fs.driver_day,
    "r4_appointment_detail": fs.r4_appointment_detail,
    "r5_outbound_calls_daily": crm.outbound_calls_daily,
    "r5_outbound_calls_total": crm.r5_outbound_calls_total,
    "r6_calls_sum": basic.r6_calls_sum,
    "r6_distinct_envelopes": basic.r6_distinct_envelopes,
    "r6_document_count": basic.r6_document_count,
    "r6_distinct_cases": basic.r6_distinct_cases,
    "r6_payment_count": basic.r6_payment_count,
    "r6_plates_mailed": basic.r6_plates_mailed,
    "r7_mean_lifecycle": crm.r7_mean_lifecycle,
    "r8_last_document_date": crm.r8_last_document_date,
    "r9_first_scan": crm.r9_first_scan,
    "r9_document_instances": crm.r9_document_instances,
    "r10_title_compliance": crm.r10_title_compliance,
    "r11_recon_cost": recon.r11_recon_cost,
    "r11_inventory_ro_parts": recon.inventory_ro_parts,
    "r11_concessions_costs": recon.concessions_costs,
    "r11_clean_expenses": recon.clean_expenses,
    "r11_parts_requests": recon.keyed_parts_requests,
    "r11_vendor_lane_costs": recon.vendor_lane_costs,
    "r12_inbound_shipping": recon.r12_inbound_shipping,
    "r13_outbound_shipping": recon.r13_outbound_shipping,
    "r14_unique_inventory": recon.r14_unique_inventory,
    "r15_duplicate_vins": basic.r15_duplicate_vins,
    "r16_theoretical_margin": qa.r16_theoretical_margin,
    "r17_open_repair_orders": qa.r17_open_repair_orders,
    "r18_snapshot_ratio": basic.r18_snapshot_ratio,
    "r19_rows_per_inventory": basic.r19_rows_per_inventory,
    "r20_vendor_tasks_without_closed_order": qa.r20_vendor_tasks_without_closed_order,
    "r21_distinct_record_types": basic.r21_distinct_record_types,
    "r21_distinct_type_names": basic.r21_distinct_type_names,
    "r22_row_lookup": basic.r22_row_lookup,
    "r22_inventory_lookup": basic.r22_inventory_lookup,
    "r22_vin_lookup": basic.r22_vin_lookup,
    "r22_appointment_lookup": basic.r22_appointment_lookup,
    "r23_open_sessions": admin.r23_open_sessions,
    "r24_recent_queries": basic.r24_recent_queries,
    "r25_user_groups": admin.r25_user_groups,
    "r26_column_acls": admin.r26_column_acls,
    "r27_privilege_matrix": admin.r27_privilege_matrix,
    "r28_group_grants": admin.r28_group_grants,
    "r29_customer_bands": admin.r29_customer_bands,
    "r30_customer_nation_store": admin.r30_customer_nation_store,
    "r31_update_then_bands": admin.r31_update_then_bands,
    "r32_running": basic.r32_running,
    "x1_quick_turnaround": fs.x1_quick_turnaround,
    "x1_outbound_then_inbound": fs.x1_outbound_then_inbound,
    "x2_turnarounds_by_period": fs.x2_turnarounds_by_period,
    "x2_appointment_turnarounds_by_period": fs.x2_appointment_turnarounds_by_period,
    "x3_same_zip_share": fs.x3_same_zip_share,
    "x4_wholesale_inbound": fs.x4_wholesale_inbound,
    "x5_repeat_customers": fs.x5_repeat_customers,
    "x6_parts_accrual": recon.x6_parts_accrual,
    "a13_duplicate_lines": basic.a13_duplicate_lines,
    "j5_orders_with_earlier_lines": bb.j5_orders_with_earlier_lines,
    "j6_customers_urgent_orders": bb.j6_customers_urgent_orders,
    "j9_not_in_with_null": bb.j9_not_in_with_null,
    "j14_names_inside_names": bb.j14_names_inside_names,
    "w1_latest_line_per_order": bb.w1_latest_line_per_order,
    "w2_order_rank_per_customer": bb.w2_order_rank_per_customer,
    "w4_order_number": bb.w4_order_number,
    "w5_first_last_kept": bb.w5_first_last_kept,
    "w9_first_last_collapsed": bb.w9_first_last_collapsed,
    "t4_minute_boundaries": bb.t4_minute_boundaries,
    "t7_events_per_local_day": bb.t7_events_per_local_day,
    "j10_customers_with_urgent_orders": bb.j10_customers_with_urgent_orders,
    "f14_flagged_lines": bb.f14_flagged_lines,
    "w8_first_last_over_groups": bb.w8_first_last_over_groups,
    "s2_three_part_name": bb.s2_three_part_name,
    "s3_role_reference": bb.s3_role_reference,
    "s7_appended_orders": bb.s7_appended_orders,
    "u1_object_names": bb.u1_object_names,
    "s4_clustered_lookup": stored.s4_clustered_lookup,
    "s4_bloom_lookup": stored.s4_bloom_lookup,
    "s6_typed_documents": stored.s6_typed_documents,
    "s6_rejected_documents": stored.s6_rejected_documents,
    "s7_repeated_batches": stored.s7_repeated_batches,
    "s7_moved_table": stored.s7_moved_table,
    "s9_refreshed_balances": stored.s9_refreshed_balances,
    "s10_updated_files": stored.s10_updated_files,
    "j3_bucketed_driver_day": stored.j3_bucketed_driver_day,
    "j3_bucketed_appointments": stored.j3_bucketed_appointments,
    "j5_earlier_lines_summary": stored.j5_earlier_lines_summary,
    "w4_stable_ids": stored.w4_stable_ids,
    "r14_repeated_inventory": stored.r14_repeated_inventory,
}


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = REPORTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Tables(spark, sf_dir))

    run.__name__ = name
    run.__doc__ = fn.__doc__
    return run
