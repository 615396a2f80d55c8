"""DuckDB SQL for the stand-in tables (same rules as opsframe.sources.standins)."""

STANDINS: dict[str, str] = {
    "candidates": """select distinct o_custkey as candidate_id, o_orderpriority as skill from orders""",
    "service_appointments": """select o_orderkey as id,
        'SA-' || cast(o_orderkey as varchar) as appointment_number,
        o_orderkey as parent_record_id, o_custkey as account_id,
        'TRK-' || cast(dayofyear(o_orderdate) % 40 as varchar) as truck_number_c,
        lpad(cast((o_custkey * 37) % 100000 as varchar), 5, '0') as postal_code,
        case when o_orderstatus = 'F' then 'Completed' else 'Scheduled' end as status,
        o_orderdate as created_date,
        o_orderdate + to_minutes(cast(o_orderkey % 1440 as bigint)) as actual_start_time,
        case when o_orderstatus != 'P' then o_orderdate + to_minutes(cast((o_orderkey * 7) % 1440 as bigint)) end as actual_end_time
        from orders""",
    "work_orders": """select o_orderkey as id, o_orderkey as delivery_order_c,
        case when o_orderstatus = 'F' then 'Completed' else 'Open' end as status from orders""",
    "accounts": "select c_custkey as id, c_name as name from customer",
    "delivery_orders": """select o_orderkey as id, lower(n_name) as managing_hub_facility_code_c,
        case when o_orderpriority = '1-URGENT' then 'delivery_to_customer'
             when o_orderpriority = '2-HIGH' then 'pickup_from_customer'
             when o_orderpriority = '3-MEDIUM' then 'buyback' else 'wholesale' end as transit_type_c,
        case when o_totalprice >= 250000 then 'retail' else 'wholesale' end as vehicle_grade_c,
        (o_orderkey % 2) = 0 as is_last_mile_c
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "assigned_resources": """select l_orderkey as service_appointment_id, l_suppkey as service_resource_id,
        case when l_returnflag != 'N' then l_shipdate end as created_date from lineitem""",
    "service_resources": """select s_suppkey as id, case when s_suppkey % 10 != 0 then s_name end as name from supplier""",
    "tasks": """select event_id as id, user_id as what_id,
        case when event_type in ('click', 'view') then 'Call' when event_type = 'signup' then 'Email' else 'Meeting' end as task_subtype,
        case when event_type = 'click' then 'Outbound' else 'Inbound' end as direction_c,
        ts as created_date, ts as activity_date_time_c from events""",
    "crm_snapshot": """select user_id as opportunity_id, cast(ts as date) as date, min(event_type) as raw_status,
        max(event_type) as derived_status, bool_or(event_type = 'purchase') as is_delivered,
        cast(ts as date) + 3 as delivery_date
        from events group by user_id, cast(ts as date)""",
    "crm_opportunities": "select c_custkey as id, c_name as opportunity_id_c from customer",
    "daily_calls": "select cast(l_shipdate as date) as date, cast(l_quantity as integer) as inbound_calls from lineitem",
    "sent_envelopes": """select 'ENV-' || cast(o_custkey as varchar) as name, o_orderdate as created_date,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Shippo' else 'Mail' end as sent_via_c from orders""",
    "crm_documents": "select event_id as id, ts as created_date from events",
    "crm_cases": "select l_orderkey as id, l_shipdate as created_date from lineitem",
    "crm_payments": "select case when o_orderstatus != 'P' then o_orderkey end as salesforce_id, o_orderdate as created_date from orders",
    "titles_registrations": """select o_orderkey as id, 'VIN-' || cast(o_custkey as varchar) as vin_c,
        'OPP-' || cast(o_orderkey as varchar) as opportunity_c,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'inbound' else 'outbound' end as record_type_id,
        case when o_orderstatus = 'P' then 'true' else 'false' end as is_deleted,
        o_orderdate as created_date,
        o_orderdate + to_days(cast(o_orderkey % 400 as integer)) as last_modified_date,
        case when o_orderkey % 5 != 0 then o_orderdate + to_days(10) end as physical_title_received_date_c,
        case when o_orderkey % 3 != 0 then o_orderdate + to_days(20) end as inbound_flip_received_date_c,
        case when o_orderkey % 4 != 0 then o_orderdate + to_days(15) end as outbound_flip_sent_date_c,
        case when o_orderkey % 7 != 0 then o_orderdate + to_days(30) end as registration_and_plates_mailed_date_c
        from orders""",
    "mail_transactions": """select l_orderkey as vrm_transaction_id, 'TRK-' || cast(l_partkey as varchar) as tracking_number,
        l_shipdate as updated_at, 'MG-' || l_linestatus as mail_group_alias from lineitem""",
    "mail_transaction_xref": """select o_orderkey as vrm_transaction_id, 'VIN-' || cast(o_custkey as varchar) as vin,
        o_custkey as inventory_id, 'OPP-' || cast(o_orderkey as varchar) as opportunity_id from orders""",
    "mail_tracking_statuses": """select o_orderkey as vrm_transaction_id,
        case when o_orderstatus = 'F' then 'DELIVERED' else 'IN_TRANSIT' end as status from orders""",
    "scan_files": """select o_orderkey as file_id, case when o_orderstatus = 'F' then 'turbo_scan' else 'upload' end as file_type,
        o_orderdate as created from orders""",
    "scan_files_xref": "select o_orderkey as file_id, 'OPP-' || cast(o_custkey as varchar) as reference_id from orders",
    "document_instances": """select 'ST-' || cast(l_suppkey % 20 as varchar) as machine_name,
        'U-' || cast(l_partkey % 50 as varchar) as created_by,
        case when l_returnflag = 'N' then 'sfp_service' when l_returnflag = 'A' then 'U-' || cast(l_suppkey % 50 as varchar) end as updated_by,
        l_shipdate as updated, l_partkey as document_definition_id, l_orderkey as envelope_id from lineitem""",
    "document_definitions": "select p_partkey as document_definition_id, p_type as name from part",
    "envelope_associations": """select o_orderkey as envelope_id, 'OPP-' || cast(o_custkey as varchar) as associated_id,
        case when o_orderstatus = 'P' then 'deal' else 'vin' end as association_type from orders""",
    "expenses": """select o_orderkey as maintid, o_custkey as inventoryid, o_orderkey % 30 as vendorid, o_orderkey % 9 as typeid,
        cast(o_totalprice as decimal(18,2)) as cost, o_orderdate as droppedoffon, o_orderpriority as comment,
        'PO-' || cast(o_orderkey as varchar) as po,
        case when o_orderstatus = 'O' then 'Ebay Listingal' else 'Standard' end as mainttype,
        case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 2 else 1 end as mainttypecategoryid,
        case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'Recon' else 'Other' end as maint_category_name,
        5 as accttypecategoryid, 'Cost of Sales' as acct_category_name,
        'expense ' || cast(o_orderkey as varchar) as description,
        case when o_orderkey % 3 != 0 then o_orderdate + to_days(5) end as workcompletedon
        from orders""",
    "inventory": """select c_custkey as inventoryid, 'VIN-' || cast(c_custkey as varchar) as vin,
        'STK-' || cast(c_custkey as varchar) as adventstockid,
        timestamp '1995-01-01' + to_days(cast(c_custkey % 1000 as integer)) as tdapurchaseddate from customer""",
    "stock_number_lookup": """select c_custkey as inventoryid,
        case when c_mktsegment != 'AUTOMOBILE' then 'STK-' || cast(c_custkey as varchar) end as stock_number from customer""",
    "recon_tasks": """select o_orderkey as taskid, o_custkey as inventoryid,
        case when o_orderpriority = '1-URGENT' then 57 else cast(o_orderkey % 50 + 11 as integer) end as tasktype,
        case when o_orderstatus = 'F' then 3 when o_orderstatus = 'O' then 2 else 1 end as taskstatus,
        o_custkey % 100 as taskvendorid, o_orderdate as taskenteredon,
        case when o_orderstatus != 'P' then o_orderdate + to_days(cast(o_orderkey % 30 as integer)) end as taskcompletedon,
        case when o_orderkey % 3 = 0 then 'Yes' when o_orderkey % 3 = 1 then 'No' end as passed,
        o_orderpriority as taskvendorcomment from orders""",
    "task_types": """select distinct p_size + 10 as id,
        case when p_size % 8 = 0 then 'we owe - ' || cast(p_size as varchar)
             when p_size % 4 = 0 then 'We Owe - ' || cast(p_size as varchar)
             else 'Type ' || cast(p_size as varchar) end as type,
        case when p_size % 6 = 0 then 'Recon' when p_size % 6 = 1 then 'Mechanical' when p_size % 6 = 2 then 'Cosmetic'
             when p_size % 6 = 3 then 'Sales' when p_size % 6 = 4 then 'Quality' else 'Inspection' end as category
        from part""",
    "task_labor": """select l_orderkey as taskid, cast(l_extendedprice as decimal(18,2)) as cost,
        cast(cast(l_quantity as decimal(18,2)) * 100 as decimal(18,2)) as estimatedcost,
        cast(l_quantity as decimal(18,2)) as hour, cast(l_quantity + 1 as decimal(18,2)) as estimatedhour,
        case when l_returnflag = 'N' then true when l_linestatus = 'O' then false end as isdeleted,
        l_linenumber % 2 = 0 as isdisclosed, l_linenumber % 3 = 0 as isperformwork, l_shipdate as completedon
        from lineitem""",
    "parts_requests": """select l_orderkey * 10 + l_linenumber as id, l_orderkey as taskid, l_partkey % 10 as parttypeid,
        l_suppkey as orderedfromvendorid, l_linenumber as requeststatus, l_shipdate - to_days(3) as enteredon,
        l_shipdate as receivedon, case when l_returnflag = 'R' then l_shipdate end as cancelledon,
        'part ' || cast(l_partkey as varchar) as description, l_linestatus as partsnotes,
        case when l_linenumber = 1 then 'NO_RO' when l_linenumber = 2 then '' else 'RO-' || cast(l_orderkey as varchar) end as adventronumber,
        cast(l_extendedprice as decimal(18,2)) as totalcost,
        case when l_discount > 0.08 then true when l_discount >= 0.02 then false end as quoteind,
        l_shipdate + to_days(1) as senttobookingon, if(l_linenumber != 5, l_shipdate + to_days(2), null) as bookedon,
        'INV-' || l_suppkey || '-' || l_linenumber as partvendorinvoicenumber, if(l_linenumber != 4, l_suppkey, null) as invoicefileid
        from lineitem""",
    "invoice_downloads": "select l_suppkey as invoicefileid, l_shipdate as datedownloaded from lineitem",
    "part_credits": """select l_orderkey * 10 + l_linenumber as partrequestid,
        -(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2))) as amount from lineitem""",
    "part_types": "select distinct p_size % 10 as id, 'PT-' || cast(p_size % 10 as varchar) as typename from part",
    "vendors": "select s_suppkey as vendorid, s_name as name from supplier",
    "remote_recon": """select 'VIN-' || cast(o_custkey as varchar) as vin, 'SITE-' || cast(o_orderkey % 5 as varchar) as recon_site,
        case when o_orderpriority = '5-LOW' then cast(o_totalprice as decimal(18,2)) end as actual_recon_cost,
        o_orderdate as created_time, case when o_orderkey % 2 = 0 then o_orderdate end as rqc_pass_date,
        o_orderdate + to_days(1) as zoned_date from orders""",
    "cost_summary": """select o_custkey as inventoryid,
        sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2)) end) as totallaborcost,
        sum(case when o_orderstatus = 'P' then cast(o_totalprice as decimal(18,2)) end) as totalpartscost,
        sum(case when o_orderstatus != 'F' then cast(o_totalprice as decimal(18,2)) else cast(0 as decimal(18,2)) end) as totalcosts
        from orders group by o_custkey""",
    "sf_delivery_orders": """select o_orderkey as id, 'PRD-' || cast(o_custkey as varchar) as vehicle_c,
        'OPP-' || cast(o_orderkey as varchar) as opportunity_c, 'CAR-' || cast(o_orderkey % 7 as varchar) as carrier_c,
        o_totalprice as delivery_cost_c, o_orderpriority as vehicle_info_c,
        case when o_orderstatus = 'O' then 'Outbound' else 'Inbound' end as type_c,
        case when o_orderkey % 3 = 0 then 'Active' when o_orderkey % 3 = 1 then 'Legacy' else 'Draft' end as shipment_record_type,
        (o_orderstatus = 'P' and o_orderkey % 2 = 0) as is_deleted, o_orderdate as created_date,
        o_orderdate + to_days(1) as actual_pickup_date_c, o_orderdate + to_days(4) as actual_delivery_date_c
        from orders""",
    "products": "select 'PRD-' || cast(c_custkey as varchar) as id, cast(c_custkey as varchar) as inventory_id_c from customer",
    "deals": """select o_orderkey as sale_number, 'STK-' || cast(o_custkey as varchar) as stock_number,
        cast(o_orderkey % 5 as integer) as type, o_orderdate as sale_date, o_orderdate + to_days(7) as ready_for_funding_date
        from orders""",
    "deal_adds": """select l_orderkey as sale_number, case when l_linenumber <= 2 then 'SHIPPING' else 'OTHER' end as code,
        'add ' || cast(l_linenumber as varchar) as description from lineitem""",
    "deal_opportunities": "select 'OPP-' || cast(o_orderkey as varchar) as id, o_orderkey as advent_sale_number_c from orders",
    "partner_sources": "select 'P-' || p_brand || '-' || p_size % 3 as partner_id, if(p_partkey % 9 != 0, p_brand, null) as source_grouped from part",
    "partners": "select distinct 'P-' || p_brand || '-' || p_size % 3 as partner_id, 'Partner ' || p_brand || ' ' || p_size % 3 as name from part",
    "evcm": """select timestamp '1998-01-01' + to_days(p_size::integer) as csv_upload_date, 'M' || p_size % 7 as rooftop_market_code,
        p_brand as source_grouped, p_type as sub_source, 'S' || p_partkey % 50 as state, lpad((p_partkey % 100000)::varchar, 5, '0') as clean_zipcodes,
        'DMA ' || p_partkey % 210 as dma, p_size as vin_count, p_size % 5 as count_of_positive_evcm, p_size * 4 as all_combination_count,
        p_retailprice / 2 as base_avg_evcm, p_retailprice / 4 as current_avg_evcm, p_retailprice as theoretical_max_evcm,
        p_partkey % 3 as unplaced_negative_evcm_count, p_partkey % 4 as unplaced_neutral_evcm_count, p_partkey % 5 as unplaced_positive_evcm_count,
        p_retailprice / 8 as unplaced_avg_evcm, if(p_size % 2 = 0, 'sold', 'open') as sale_status_flag from part""",
    "repair_orders": """select o_orderkey as repair_order_number, 'VIN-' || cast(o_custkey as varchar) as vin,
        o_orderstatus as status, o_orderdate as open_date,
        case when o_orderstatus = 'F' then o_orderdate + to_days(2) end as closed_date, o_orderpriority as advisor,
        if(o_orderstatus = 'F', o_orderdate + to_days(3), null) as accounting_date, o_custkey % 100000 as mileage_in,
        o_custkey % 100000 + o_orderkey % 50 as mileage_out from orders""",
    "repair_order_lines": """select l_orderkey as repair_order_number, l_linenumber as job_number,
        'concern ' || cast(l_partkey as varchar) as concern, l_linestatus as status, l_returnflag as department,
        'cause ' || l_suppkey as cause, 'correction ' || l_linenumber as correction, if(l_linestatus = 'O', 'retail', 'internal') as sale_type,
        l_returnflag || l_linestatus as sub_sale_type from lineitem""",
    "closed_repair_orders": "select l_orderkey as adventronumber from lineitem where l_returnflag = 'R'",
    "closed_repair_orders_null7": """select case when l_linenumber != 7 then l_orderkey end as adventronumber
        from lineitem where l_returnflag = 'R'""",
    "stock_received": """select 'VIN-' || cast(o_custkey as varchar) as vin, 'STK-' || cast(o_custkey as varchar) as stock_number,
        o_orderdate + to_days(3) as received_date from orders""",
    "vendor_tasks": """select l_orderkey * 10 + l_linenumber as taskid, cast(l_partkey % 50 + 11 as integer) as tasktype,
        case when l_linestatus = 'O' then 10 else 3 end as taskstatus, l_shipdate as taskenteredon,
        l_shipdate + to_days(2) as taskcompletedon, l_partkey as inventoryid, l_suppkey as taskvendorid,
        l_returnflag as taskvendorcomment, l_extendedprice as estimatedcost,
        case when l_returnflag = 'A' then 'Yes' else 'No' end as passed,
        case when l_linenumber = 7 then 'NO_RO' when l_linenumber = 6 then '' else cast(l_orderkey as varchar) end as adventronumber,
        l_suppkey % 100 as taskowner, 'task ' || l_partkey as taskdescription, l_shipdate + to_days(1) as taskstartedon,
        l_linenumber % 3 as priority, l_shipdate + to_days(3) as taskreadyforpickupon, l_linestatus as taskvendorstatus,
        if(l_returnflag = 'A', l_shipdate + to_days(1), null) as taskvendorapprovedon, l_shipdate + to_days(4) as taskestimatedreadytime,
        l_partkey % 1000 as resourceid, l_linenumber as estimatedhours, l_orderkey % 500 as inttaskerid, l_suppkey as exttaskerid,
        l_orderkey % 100 as enteredby, l_linenumber % 5 as reasoncodeid, l_shipdate + to_days(5) as bookdate, l_shipdate + to_days(4) as senttobookingon
        from lineitem""",
    "closed_orders": "select cast(o_orderkey as varchar) as adventronumber from orders where o_orderstatus = 'F'",
    "connection_log": """select ts as recordtime, 'user_' || cast(user_id as varchar) as username, 'dev' as dbname,
        '10.0.0.' || cast(user_id % 250 as varchar) as remotehost, event_id % 60000 + 1024 as remoteport,
        case when event_type = 'signup' then 'initiating session' when event_type = 'error' then 'disconnecting session'
             else 'authenticated' end as event,
        user_id * 100 + dayofmonth(ts) as pid from events""",
    "query_log": """select user_id as userid, event_id as query, user_id % 10 as pid, props as substring, ts as starttime,
        ts + to_seconds(cast(floor(value) as bigint)) as endtime, cast(floor(value * 1000) as bigint) as elapsed,
        case when event_type = 'error' then 1 else 0 end as aborted from events""",
    "activity": """select 'user_' || cast(user_id as varchar) as user_name, 'dev' as db_name, user_id as pid, props as query,
        case when event_type = 'view' then 'Running' else 'Done' end as status from events""",
    "catalog_users": "select s_suppkey as usesysid, s_name as usename from supplier",
    "catalog_groups": """select 'grp_' || cast(o_orderkey as varchar) as groname,
        [o_custkey, o_custkey + o_orderkey % 3, o_custkey] as grolist from orders""",
    "member_users": "select c_custkey as usesysid, c_name as usename from customer",
    "acl_objects": """select s_suppkey as oid, lower(s_name) as relname, 'r' as relkind, s_nationkey as relowner,
        s_nationkey as relnamespace,
        case when s_suppkey % 6 != 5 then
          [n_name || '=' || substring('rwadRxtXUCT', 1, cast(s_suppkey % 11 + 1 as integer)) || '/' || lower(n_name),
           'group ' || s_name || '=r/' || lower(n_name)] end as relacl
        from supplier join nation on s_nationkey = n_nationkey""",
    "acl_users": "select n_nationkey as usesysid, lower(n_name) as usename from nation",
    "acl_namespaces": "select n_nationkey as oid, 'ns_' || lower(n_name) as nspname from nation",
    "acl_groups": "select n_name as groname, [cast(n_nationkey as bigint)] as grolist from nation union all select s_name, [s_suppkey] from supplier",
    "column_acls": """select l_suppkey as attrelid, 'c_' || l_orderkey || '_' || l_linenumber as attname,
        case when l_tax >= 0.05 then ['u' || cast(l_partkey as varchar) || '=r/owner'] end as attacl from lineitem""",
    "customers": """select c_custkey as customerid, c_name as customername,
        cast(c_nationkey + 10 as varchar) || '-' || cast(c_custkey as varchar) as phone, c_nationkey as nationid,
        c_mktsegment as marketsegment, c_acctbal as accountbalance from customer""",
    "nations": "select n_nationkey as nationid, n_name as nationname from nation",
}


def with_(names, body: str) -> str:
    """``WITH <stand-ins> <body>`` for the named stand-ins."""
    ctes = ",\n".join(f"{n} as ({STANDINS[n]})" for n in names)
    return f"with {ctes}\n{body}"
