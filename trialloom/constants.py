"""Vocabularies, thresholds and defaults the results depend on."""

# Subjects that never enter an analysis.
EXCLUDED_SUBJECTS = [
    'SP076', 'SP075', 'SP074', 'SP073', 'SP072', 'SP066', 'VIV-47627', 'VIV-47615', 'VIV-45598', 'VIV-45585',
    'photometry_test_subject_A', 'photometry_test_subject_B', 'test_mouse',
]
VALID_STRAINS = [
    'B6.Cg', 'B6.129S2', 'B6J.Cg-Gt', 'B6.Cg-Igs7', 'C57BL/6J', 'B6.129(Cg)-Slc6a4', 'B6.SJL-Slc6a3t',
    'B6;129S6-Chat', 'B6.Cg-Dbh',
]
STRAIN_TO_NM = {
    'Ai148xSERTCre': '5HT', 'Ai148xDATCre': 'DA', 'Ai148xDbhCre': 'NE', 'Ai148xDbh-Cre': 'NE',
    'Ai148xTHCre': 'NE', 'Ai148xChATCre': 'ACh', 'Ai95xSERTCre': '5HT',
}
VALID_LINES = ['Ai148xSert', 'Ai148xDat', 'Ai148xDbh', 'Ai148xTh', 'Ai148xChat', 'Ai148cdhxChat']
LINE_TO_NM = {
    'Ai148xSert': '5HT', 'Ai148xDat': 'DA', 'Ai148xDbh': 'NE', 'Ai148xTh': 'NE', 'Ai148xChat': 'ACh',
    'Ai148-G6f-cdh x Chat-cre': 'ACh',
}
VALID_NEUROMODULATORS = ['DA', '5HT', 'NE', 'ACh']
REGION_NAME_FIXES = {'DRN': 'DR', 'SNC': 'SNc'}
VALID_TARGETS = ['VTA', 'SNc', 'DR', 'MR', 'LC', 'NBM', 'SI', 'PPT']
VALID_TARGET_NMS = ['VTA-DA', 'SNc-DA', 'DR-5HT', 'MR-5HT', 'LC-NE', 'NBM-ACh', 'SI-ACh', 'PPT-ACh']
TARGET_TO_NM = {
    'VTA': 'DA', 'SNc': 'DA', 'DR': '5HT', 'MR': '5HT', 'LC': 'NE', 'NBM': 'ACh', 'SI': 'ACh', 'PPT': 'ACh',
}
ANALYSED_TARGET_NMS = ['VTA-DA', 'SNc-DA', 'DR-5HT', 'LC-NE', 'NBM-ACh']
DATASET_CATEGORIES = {
    'raw_task': [
        'raw_behavior_data/_iblrig_taskData.raw.jsonable', 'raw_task_data_00/_iblrig_taskData.raw.jsonable',
    ],
    'raw_video': ['raw_video_data/_iblrig_leftCamera.raw.mp4'],
    'raw_photometry_channels': ['raw_photometry_data/_neurophotometrics_fpData.channels.csv'],
    'raw_photometry_signals': ['raw_photometry_data/_neurophotometrics_fpData.raw.pqt'],
    'extracted_task': ['alf/_ibl_trials.table.pqt', 'alf/task_00/_ibl_trials.table.pqt'],
    'extracted_wheel': ['alf/_ibl_wheel.position.npy', 'alf/task_00/_ibl_wheel.position.npy'],
    'extracted_photometry_signal': ['alf/photometry/photometry.signal.pqt'],
    'extracted_photometry_locations': ['alf/photometry/photometryROI.locations.pqt'],
}
SESSION_TYPES = ['habituation', 'training', 'advanced', 'neuromodulator', 'biased', 'ephys', 'passive', 'histology']
ANALYSED_SESSION_TYPES = ['training', 'biased', 'ephys']
EXCLUDED_SESSION_TYPES = ['habituation', 'advanced', 'neuromodulator', 'passive', 'misc', 'histology']
PROTOCOL_RED_FLAGS = ['RPE', 'DELAY', 'delay']
RESPONSE_EVENTS = ['stimOn_times', 'feedback_times']
ERROR_COLUMNS = ['eid', 'error_type', 'error_message', 'traceback']
ANALYSIS_BLOCKERS = [
    'MissingExtractedData', 'MissingRawData', 'InsufficientTrials', 'IncompleteEventTimes',
    'TrialsNotInPhotometryTime', 'QCValidationError', 'AmbiguousRegionMapping', 'MissingBlockInfo',
]
QC_SCORES = {
    'nan': 0.0, 'NOT SET': 0.01, 'NOT_SET': 0.01, 'PASS': 1.0, 'WARNING': 0.66, 'CRITICAL': 0.33, 'FAIL': 0.1,
}
QC_ORDER = ['NOT_SET', 'CRITICAL', 'FAIL', 'WARNING', 'PASS']
VIDEO_QC_COLUMNS = [
    'qc_videoLeft_focus', 'qc_videoLeft_position', 'qc_videoLeft_brightness', 'qc_videoLeft_resolution',
    'qc_videoLeft_wheel_alignment', 'qc_videoLeft_timestamps', 'qc_videoLeft_dropped_frames',
    'qc_videoLeft_pin_state',
]
VIDEO_QUALITY_COLUMNS = VIDEO_QC_COLUMNS[:5]
EVENT_COLUMNS_CHECKED = ['goCue_times', 'firstMovement_times', 'feedback_times']

RESPONSE_WINDOW = (-1.0, 1.0)
BASELINE_WINDOW = (-0.1, 0.0)
EARLY_WINDOW = (0.1, 0.35)
SIGNAL_HZ, WHEEL_HZ, POSE_HZ = 30, 100, 30
MIN_TRIALS = 90
MIN_EVENT_COMPLETENESS = 0.9
MIN_BLOCK_LENGTH = 10
MIN_TRAINING_PERFORMANCE = 0.70
REQUIRED_CONTRASTS = [0.0, 6.25, 12.5, 25.0, 100.0]
UNIQUE_SAMPLE_THRESHOLD = 0.1
QC_WINDOW_SECONDS, QC_STEP_SECONDS = 120, 60
POSE_LIKELIHOOD = 0.9
XCORR_LAG_SECONDS = 5.0
FALSE_START_SECONDS = 0.05
MIN_MODEL_TRIALS = 50
LENGTH_MISMATCH_SECONDS = 120
VARCOMP_MIN_MICE, VARCOMP_MIN_SESSIONS, VARCOMP_GRID, VARCOMP_HDI = 4, 5, 200, 0.94
DISPERSION_MIN_SESSIONS = 3
ENCODING_DT, ENCODING_LAGS, ENCODING_FOLDS = 0.1, 50, 5
BASIS_COUNT, BASIS_SECONDS, BASIS_OFFSET = 10, 2.5, 0.2
