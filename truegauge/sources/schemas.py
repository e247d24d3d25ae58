"""Canonical tables. Times are integer microseconds from the session start; missing stays null."""

from __future__ import annotations

# DDL by table; probe names are lower case, (eid, probe_name, cluster_id) names a unit.
SCHEMAS = {
    "spikes": "eid string, probe_name string, cluster_id int, t_us bigint",
    "units": ("eid string, probe_name string, cluster_id int, cluster_uuid string, region string, "
              "depth double, hemisphere string, x double, y double, z double, amp double, "
              "contamination double, label double, rp_violation double, noise_cutoff double, "
              "presence_ratio double, firing_rate float, extras map<string,string>"),
    "trials": ("eid string, trial_id int, stim_on_us bigint, stim_off_us bigint, choice int, "
               "feedback int, feedback_us bigint, contrast double, probability_left double, "
               "block_index int, response_us bigint"),
    "behaviour": "eid string, series string, sample_idx bigint, t_us bigint, value double",
    "capabilities": "eid string, capability string, present boolean, reason string",
    "epochs": "eid string, state string, start_us bigint, end_us bigint",
}
