"""Twenty-odd reports with every step of their labelling written down: the values that SQL checks the engine by.

The reports are those whose outcomes the contracts of the labelling name, in six languages, with collective statements, a
linked view, conflicts, compartments and vetoes. Clauses, base mentions and mentions were written down once from the
detectors, read against the contracts by hand and are fixed since. All that follows from them (propositions,
statuses, provenance, summaries) is derived from these rows by the SQL below, independently of the engine.
"""

from __future__ import annotations

from reportmill.functions import vocabulary as V

#: (report, language group)
TEMPLATES = (
    ('Findings: ACL tear.', 'english'),
    ('Findings: No ACL tear.', 'english'),
    ('Possible ACL tear.', 'latin_other'),
    ('Findings: small joint effusion.', 'english'),
    ('Clinical history: suspected ACL tear. Findings: ACL intact.', 'english'),
    ('Findings: Lateral meniscus tear without extrusion.', 'english'),
    ('Findings: Medial meniscus intact.', 'english'),
    ('Findings: no joint effusion. MCL intact.', 'english'),
    ('Nalaz: Sitna Baker cista.', 'south_slavic'),
    ('Findings: fracture of the tibial plateau.', 'english'),
    ('Findings: bone contusion.', 'english'),
    ('Findings: synovitis.', 'english'),
    ('Retinacular defect not seen.', 'latin_other'),
    ('Ligamentos cruzados y colaterales de grosor y señal normales.', 'latin_other'),
    ('Both menisci are intact.', 'latin_other'),
    ('Tears involve both menisci.', 'latin_other'),
    ('Cartílago de compartimentos femorotibiales de grosor y señal normal.', 'latin_other'),
    ('CONSTATATIONS :\nFractures :\nAucune.', 'french'),
    ('ACL intact. ACL intact. ACL tear.', 'latin_other'),
    ('Bulgular: Eklemde sıvı artışı saptanmamıştır.', 'turkish'),
    ('Befund: Gelenkerguss mit verdickter Synovia und synovialen Proliferationen.', 'german'),
    ("Constatations: Il n'y a pas de trait fracturaire.", 'french'),
    ('Bevindingen: Denudatie van het kraakbeen mediaal femorotibiaal met osteofyten.', 'dutch'),
    ('Findings: Mild to moderate medial and lateral femorotibial chondrosis.', 'english'),
    ('Findings: a cystic lesion in front of the ACL. ACL is intact.', 'english'),
    ('Findings: preserved medial and lateral tibiofemoral cartilage; focal cartilage loss at the femoral trochlea.', 'english'),
    ('Findings: tricompartmental osteoarthritis.', 'english'),
    ('Medial meniscus tear displaced into the gutter adjacent to the MCL.', 'english'),
    ('ACL:\nmucoid degeneration, edema.\nPossible joint effusion.', 'latin_other'),
    ('Nalaz: Degenerativno promijenjen lateralni menisk, bez znakova rupture.', 'south_slavic'),
    ('Both menisci are possibly torn.', 'latin_other'),
)

#: (template, clause number, text, section, diagnostic, raw text or None where it cannot be aligned)
CLAUSES = (
    (0, 0, 'findings: acl tear.', 'findings', True, 'Findings: ACL tear.'),
    (1, 0, 'findings: no acl tear.', 'findings', True, 'Findings: No ACL tear.'),
    (2, 0, 'possible acl tear.', 'unspecified', True, 'Possible ACL tear.'),
    (3, 0, 'findings: small joint effusion.', 'findings', True, 'Findings: small joint effusion.'),
    (4, 0, 'clinical history: suspected acl tear.', 'clinical history', False, 'Clinical history: suspected ACL tear.'),
    (4, 1, 'findings: acl intact.', 'findings', True, 'Findings: ACL intact.'),
    (5, 0, 'findings: lateral meniscus tear without extrusion.', 'findings', True, 'Findings: Lateral meniscus tear without extrusion.'),
    (6, 0, 'findings: medial meniscus intact.', 'findings', True, 'Findings: Medial meniscus intact.'),
    (7, 0, 'findings: no joint effusion.', 'findings', True, 'Findings: no joint effusion.'),
    (7, 1, 'mcl intact.', 'findings', True, 'MCL intact.'),
    (8, 0, 'nalaz: sitna baker cista.', 'nalaz', True, 'Nalaz: Sitna Baker cista.'),
    (9, 0, 'findings: fracture of the tibial plateau.', 'findings', True, 'Findings: fracture of the tibial plateau.'),
    (10, 0, 'findings: bone contusion.', 'findings', True, 'Findings: bone contusion.'),
    (11, 0, 'findings: synovitis.', 'findings', True, 'Findings: synovitis.'),
    (12, 0, 'retinacular defect not seen.', 'unspecified', True, 'Retinacular defect not seen.'),
    (13, 0, 'ligamentos cruzados y colaterales de grosor y senal normales.', 'unspecified', True, 'Ligamentos cruzados y colaterales de grosor y señal normales.'),
    (14, 0, 'both menisci are intact.', 'unspecified', True, 'Both menisci are intact.'),
    (15, 0, 'tears involve both menisci.', 'unspecified', True, 'Tears involve both menisci.'),
    (16, 0, 'cartilago de compartimentos femorotibiales de grosor y senal normal.', 'unspecified', True, 'Cartílago de compartimentos femorotibiales de grosor y señal normal.'),
    (17, 0, 'constatations :', 'constatations', True, 'CONSTATATIONS :'),
    (17, 1, 'fractures : aucune.', 'constatations', True, 'Fractures : Aucune.'),
    (18, 0, 'acl intact.', 'unspecified', True, 'ACL intact.'),
    (18, 1, 'acl intact.', 'unspecified', True, 'ACL intact.'),
    (18, 2, 'acl tear.', 'unspecified', True, 'ACL tear.'),
    (19, 0, 'bulgular: eklemde sivi artisi saptanmamistir.', 'bulgular', True, 'Bulgular: Eklemde sıvı artışı saptanmamıştır.'),
    (20, 0, 'befund: gelenkerguss mit verdickter synovia und synovialen proliferationen.', 'befund', True, 'Befund: Gelenkerguss mit verdickter Synovia und synovialen Proliferationen.'),
    (21, 0, "constatations: il n'y a pas de trait fracturaire.", 'constatations', True, "Constatations: Il n'y a pas de trait fracturaire."),
    (22, 0, 'bevindingen: denudatie van het kraakbeen mediaal femorotibiaal met osteofyten.', 'bevindingen', True, 'Bevindingen: Denudatie van het kraakbeen mediaal femorotibiaal met osteofyten.'),
    (23, 0, 'findings: mild to moderate medial and lateral femorotibial chondrosis.', 'findings', True, 'Findings: Mild to moderate medial and lateral femorotibial chondrosis.'),
    (24, 0, 'findings: a cystic lesion in front of the acl.', 'findings', True, 'Findings: a cystic lesion in front of the ACL.'),
    (24, 1, 'acl is intact.', 'findings', True, 'ACL is intact.'),
    (25, 0, 'findings: preserved medial and lateral tibiofemoral cartilage;', 'findings', True, 'Findings: preserved medial and lateral tibiofemoral cartilage;'),
    (25, 1, 'focal cartilage loss at the femoral trochlea.', 'findings', True, 'focal cartilage loss at the femoral trochlea.'),
    (26, 0, 'findings: tricompartmental osteoarthritis.', 'findings', True, 'Findings: tricompartmental osteoarthritis.'),
    (27, 0, 'medial meniscus tear displaced into the gutter adjacent to the mcl.', 'unspecified', True, 'Medial meniscus tear displaced into the gutter adjacent to the MCL.'),
    (28, 0, 'acl: mucoid degeneration, edema.', 'unspecified', True, 'ACL: mucoid degeneration, edema.'),
    (28, 1, 'possible joint effusion.', 'unspecified', True, 'Possible joint effusion.'),
    (29, 0, 'nalaz: degenerativno promijenjen lateralni menisk, bez znakova rupture.', 'nalaz', True, 'Nalaz: Degenerativno promijenjen lateralni menisk, bez znakova rupture.'),
    (30, 0, 'both menisci are possibly torn.', 'unspecified', True, 'Both menisci are possibly torn.'),
)

#: Views beyond one a clause: (template, view number, text, section, source clauses)
LINKED = (
    (17, 2, 'constatations : fractures : aucune.', 'constatations', [0, 1]),
)

#: Mentions of the base policy: (template, order, target, status, clause number, rule of a collective statement or None)
BASE = (
    (0, 0, 'ACL', 'positive', 0, None),
    (1, 0, 'ACL', 'negative', 0, None),
    (2, 0, 'ACL', 'uncertain', 0, None),
    (3, 0, 'Effusion', 'positive', 0, None),
    (4, 0, 'ACL', 'negative', 1, None),
    (5, 0, 'Lateral Meniscus', 'positive', 0, None),
    (6, 0, 'Medial Meniscus', 'negative', 0, None),
    (7, 0, 'MCL', 'negative', 1, None),
    (7, 1, 'Effusion', 'negative', 0, None),
    (9, 0, 'Fracture', 'positive', 0, None),
    (10, 0, 'Contusion', 'positive', 0, None),
    (11, 0, 'Synovitis', 'positive', 0, None),
    (13, 0, 'ACL', 'negative', 0, 'cruciate_ligaments'),
    (13, 1, 'ACL', 'negative', 0, 'cruciate_and_collateral_ligaments'),
    (13, 2, 'MCL', 'negative', 0, 'cruciate_and_collateral_ligaments'),
    (14, 0, 'Medial Meniscus', 'negative', 0, 'both_menisci'),
    (14, 1, 'Medial Meniscus', 'negative', 0, 'both_menisci_negative_only'),
    (14, 2, 'Lateral Meniscus', 'negative', 0, 'both_menisci'),
    (14, 3, 'Lateral Meniscus', 'negative', 0, 'both_menisci_negative_only'),
    (15, 0, 'Medial Meniscus', 'positive', 0, 'both_menisci'),
    (15, 1, 'Lateral Meniscus', 'positive', 0, 'both_menisci'),
    (16, 0, 'Medial OA', 'negative', 0, 'tibiofemoral_compartments'),
    (16, 1, 'Lateral OA', 'negative', 0, 'tibiofemoral_compartments'),
    (17, 0, 'Fracture', 'negative', 1, None),
    (18, 0, 'ACL', 'negative', 0, None),
    (18, 1, 'ACL', 'negative', 1, None),
    (18, 2, 'ACL', 'positive', 2, None),
    (19, 0, 'Effusion', 'negative', 0, None),
    (20, 0, 'Effusion', 'positive', 0, None),
    (23, 0, 'Lateral OA', 'positive', 0, None),
    (24, 0, 'ACL', 'positive', 0, None),
    (24, 1, 'ACL', 'negative', 1, None),
    (25, 0, 'Medial OA', 'negative', 0, 'tibiofemoral_compartments'),
    (25, 1, 'Lateral OA', 'negative', 0, None),
    (26, 0, 'Medial OA', 'positive', 0, None),
    (26, 1, 'Lateral OA', 'positive', 0, None),
    (26, 2, 'PF OA', 'positive', 0, None),
    (27, 0, 'Medial Meniscus', 'positive', 0, None),
    (28, 0, 'ACL', 'positive', 0, None),
    (28, 1, 'Effusion', 'uncertain', 1, None),
    (29, 0, 'Lateral Meniscus', 'negative', 0, None),
    (30, 0, 'Medial Meniscus', 'uncertain', 0, 'both_menisci'),
    (30, 1, 'Lateral Meniscus', 'uncertain', 0, 'both_menisci'),
)

#: Mentions of the morphology policy: (template, order, target, status, phenotype, detector, view number, language, confidence, span start, span end, rule)
MENTIONS = (
    (0, 0, 'ACL', 'positive', 'tear', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (0, 1, 'ACL', 'positive', 'tear', 'v3_target', 0, 'english', 0.87, 14, 18, 'target_local_association'),
    (1, 0, 'ACL', 'negative', 'abnormality_absent', 'v2_exact', 0, 'english', 0.85, None, None, None),
    (1, 1, 'ACL', 'negative', 'abnormality_absent', 'v3_target', 0, 'english', 0.82, 17, 21, 'target_local_association'),
    (2, 0, 'ACL', 'uncertain', 'tear', 'v2_exact', 0, 'latin_other', 0.5, None, None, None),
    (2, 1, 'ACL', 'uncertain', 'tear', 'v3_target', 0, 'latin_other', 0.5, 13, 17, 'target_local_association'),
    (3, 0, 'Effusion', 'positive', 'abnormality', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (3, 1, 'Effusion', 'positive', 'joint_effusion', 'v3_morphology', 0, 'english', 0.88, 16, 30, 'effusion_en_plural'),
    (4, 0, 'ACL', 'negative', 'abnormality_absent', 'v2_exact', 1, 'english', 0.85, None, None, None),
    (4, 1, 'ACL', 'negative', 'normal_structure', 'v3_target', 1, 'english', 0.82, 14, 20, 'target_local_normality'),
    (5, 0, 'Lateral Meniscus', 'positive', 'tear', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (5, 1, 'Lateral Meniscus', 'positive', 'tear', 'v3_target', 0, 'english', 0.87, 27, 31, 'target_local_association'),
    (6, 0, 'Medial Meniscus', 'negative', 'abnormality_absent', 'v2_exact', 0, 'english', 0.85, None, None, None),
    (6, 1, 'Medial Meniscus', 'negative', 'normal_structure', 'v3_target', 0, 'english', 0.82, 26, 32, 'target_local_normality'),
    (7, 0, 'MCL', 'negative', 'abnormality_absent', 'v2_exact', 1, 'english', 0.85, None, None, None),
    (7, 1, 'Effusion', 'negative', 'abnormality_absent', 'v2_exact', 0, 'english', 0.85, None, None, None),
    (7, 2, 'Effusion', 'negative', 'joint_effusion_absent', 'v3_morphology', 0, 'english', 0.83, 13, 27, 'effusion_en_plural'),
    (7, 3, 'MCL', 'negative', 'normal_structure', 'v3_target', 1, 'english', 0.82, 4, 10, 'target_local_normality'),
    (8, 0, "Baker's", 'positive', 'baker_cyst', 'v3_morphology', 0, 'english', 0.88, 13, 24, 'baker_variants'),
    (8, 1, "Baker's", 'positive', 'baker_cyst', 'v3_morphology', 0, 'south_slavic', 0.88, 13, 24, 'baker_sl'),
    (9, 0, 'Fracture', 'positive', 'fracture', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (9, 1, 'Fracture', 'positive', 'fracture', 'v3_morphology', 0, 'english', 0.88, 10, 18, 'fracture_en'),
    (10, 0, 'Contusion', 'positive', 'abnormality', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (10, 1, 'Contusion', 'positive', 'bone_contusion', 'v3_morphology', 0, 'english', 0.88, 10, 24, 'contusion_en'),
    (11, 0, 'Synovitis', 'positive', 'abnormality', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (13, 0, 'ACL', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'cruciate_ligaments'),
    (13, 1, 'ACL', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'cruciate_and_collateral_ligaments'),
    (13, 2, 'MCL', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'cruciate_and_collateral_ligaments'),
    (14, 0, 'Medial Meniscus', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'both_menisci'),
    (14, 1, 'Medial Meniscus', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'both_menisci_negative_only'),
    (14, 2, 'Lateral Meniscus', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'both_menisci'),
    (14, 3, 'Lateral Meniscus', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'both_menisci_negative_only'),
    (15, 0, 'Medial Meniscus', 'positive', 'tear', 'v2_collective', 0, 'latin_other', 0.8, None, None, 'both_menisci'),
    (15, 1, 'Lateral Meniscus', 'positive', 'tear', 'v2_collective', 0, 'latin_other', 0.8, None, None, 'both_menisci'),
    (16, 0, 'Medial OA', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'tibiofemoral_compartments'),
    (16, 1, 'Lateral OA', 'negative', 'abnormality_absent', 'v2_collective', 0, 'latin_other', 0.75, None, None, 'tibiofemoral_compartments'),
    (17, 0, 'Fracture', 'negative', 'abnormality_absent', 'v2_exact', 1, 'french', 0.85, None, None, None),
    (17, 1, 'Fracture', 'negative', 'fracture_absent', 'v3_morphology', 1, 'english', 0.83, 0, 9, 'fracture_en'),
    (17, 2, 'Fracture', 'negative', 'fracture_absent', 'v3_morphology', 1, 'french', 0.83, 0, 9, 'fracture_fr'),
    (17, 3, 'Fracture', 'negative', 'fracture_absent', 'v3_morphology', 2, 'english', 0.83, 16, 25, 'fracture_en'),
    (17, 4, 'Fracture', 'negative', 'fracture_absent', 'v3_morphology', 2, 'french', 0.83, 16, 25, 'fracture_fr'),
    (18, 0, 'ACL', 'negative', 'abnormality_absent', 'v2_exact', 1, 'latin_other', 0.85, None, None, None),
    (18, 1, 'ACL', 'negative', 'abnormality_absent', 'v2_exact', 1, 'latin_other', 0.85, None, None, None),
    (18, 2, 'ACL', 'positive', 'tear', 'v2_exact', 2, 'latin_other', 0.9, None, None, None),
    (18, 3, 'ACL', 'negative', 'normal_structure', 'v3_target', 0, 'latin_other', 0.82, 4, 10, 'target_local_normality'),
    (18, 4, 'ACL', 'negative', 'normal_structure', 'v3_target', 1, 'latin_other', 0.82, 4, 10, 'target_local_normality'),
    (18, 5, 'ACL', 'positive', 'tear', 'v3_target', 2, 'latin_other', 0.87, 4, 8, 'target_local_association'),
    (19, 0, 'Effusion', 'negative', 'abnormality_absent', 'v2_exact', 0, 'turkish', 0.85, None, None, None),
    (19, 1, 'Effusion', 'negative', 'joint_effusion_absent', 'v3_morphology', 0, 'turkish', 0.83, 10, 29, 'effusion_tr_root'),
    (20, 0, 'Effusion', 'positive', 'abnormality', 'v2_exact', 0, 'german', 0.9, None, None, None),
    (20, 1, 'Effusion', 'positive', 'joint_effusion', 'v3_morphology', 0, 'german', 0.88, 8, 20, 'effusion_de_root'),
    (20, 2, 'Synovitis', 'positive', 'synovitis', 'v3_morphology', 0, 'german', 0.88, 48, 74, 'synovitis_de'),
    (21, 0, 'Fracture', 'negative', 'fracture_absent', 'v3_morphology', 0, 'english', 0.83, 37, 48, 'fracture_en'),
    (21, 1, 'Fracture', 'negative', 'fracture_absent', 'v3_morphology', 0, 'french', 0.83, 37, 48, 'fracture_fr'),
    (22, 0, 'Medial OA', 'positive', 'chondral_abnormality', 'v3_target', 0, 'dutch', 0.87, 67, 77, 'compartment_scope'),
    (23, 0, 'Lateral OA', 'positive', 'chondral_abnormality', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (23, 1, 'Medial OA', 'positive', 'chondral_abnormality', 'v3_target', 0, 'english', 0.87, 59, 69, 'compartment_scope'),
    (23, 2, 'Lateral OA', 'positive', 'chondral_abnormality', 'v3_target', 0, 'english', 0.87, 59, 69, 'compartment_scope'),
    (24, 0, 'ACL', 'negative', 'abnormality_absent', 'v2_exact', 1, 'english', 0.85, None, None, None),
    (24, 1, 'ACL', 'negative', 'normal_structure', 'v3_target', 1, 'english', 0.82, 7, 13, 'target_local_normality'),
    (25, 0, 'Medial OA', 'negative', 'abnormality_absent', 'v2_collective', 0, 'english', 0.75, None, None, 'tibiofemoral_compartments'),
    (25, 1, 'Lateral OA', 'negative', 'abnormality_absent', 'v2_exact', 0, 'english', 0.85, None, None, None),
    (25, 2, 'Medial OA', 'negative', 'normal_cartilage', 'v3_target', 0, 'english', 0.82, 10, 19, 'compartment_normality'),
    (25, 3, 'Lateral OA', 'negative', 'normal_cartilage', 'v3_target', 0, 'english', 0.82, 10, 19, 'compartment_normality'),
    (25, 4, 'PF OA', 'positive', 'chondral_abnormality', 'v3_target', 1, 'english', 0.87, 6, 20, 'compartment_scope'),
    (26, 0, 'Medial OA', 'positive', 'abnormality', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (26, 1, 'Lateral OA', 'positive', 'abnormality', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (26, 2, 'PF OA', 'positive', 'abnormality', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (27, 0, 'Medial Meniscus', 'positive', 'tear', 'v2_exact', 0, 'english', 0.9, None, None, None),
    (27, 1, 'Medial Meniscus', 'positive', 'tear', 'v3_target', 0, 'english', 0.87, 16, 20, 'target_local_association'),
    (28, 0, 'ACL', 'positive', 'degeneration', 'v2_exact', 0, 'latin_other', 0.9, None, None, None),
    (28, 1, 'Effusion', 'uncertain', 'abnormality', 'v2_exact', 1, 'latin_other', 0.5, None, None, None),
    (28, 2, 'Effusion', 'uncertain', 'joint_effusion', 'v3_morphology', 1, 'english', 0.5, 9, 23, 'effusion_en_plural'),
    (28, 3, 'ACL', 'positive', 'degeneration', 'v3_target', 0, 'latin_other', 0.87, 5, 11, 'target_local_association'),
    (29, 0, 'Lateral Meniscus', 'negative', 'abnormality_absent', 'v2_exact', 0, 'south_slavic', 0.85, None, None, None),
    (29, 1, 'Lateral Meniscus', 'positive', 'degeneration', 'v3_target', 0, 'south_slavic', 0.87, 7, 20, 'target_local_association'),
    (30, 0, 'Medial Meniscus', 'uncertain', 'tear', 'v2_collective', 0, 'latin_other', 0.45, None, None, 'both_menisci'),
    (30, 1, 'Lateral Meniscus', 'uncertain', 'tear', 'v2_collective', 0, 'latin_other', 0.45, None, None, 'both_menisci'),
)

def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return "[" + ", ".join(map(_literal, x)) + "]" if isinstance(x, list) else str(x)


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


TARGETS_SQL = _values("targets", "ord, target", enumerate(V.TARGETS))
#: The written rows as tables; docs_t gives each document its template by its id.
FACTS_SQL = ", ".join([
    TARGETS_SQL, _values("templates", "tid, report, language_group", ((i, *t) for i, t in enumerate(TEMPLATES))),
    _values("clause", "tid, idx, text, section, diagnostic, raw", CLAUSES), _values("linked", "tid, view_no, text, section, sources", LINKED),
    _values("base_row", "tid, ord, target, status, idx, rule", BASE),
    _values("mention_row", "tid, ord, target, status, phenotype, detector, view_no, language, confidence, s, e, rule", MENTIONS),
    f"""docs_t AS (SELECT d.doc_id AS study, t.tid, t.report, t.language_group FROM documents d JOIN templates t ON t.tid = d.doc_id % {len(TEMPLATES)}),
view AS (SELECT tid, idx AS view_no, text, section, 'strict' AS kind, [idx] AS sources, diagnostic FROM clause UNION ALL SELECT tid, view_no, text, section, 'linked', sources, true FROM linked),
base AS (SELECT b.*, c.text, rule IS NOT NULL AS collective FROM base_row b JOIN clause c USING (tid, idx)),
mention AS (
  SELECT m.*, CAST(m.confidence AS DOUBLE) AS conf, v.text, v.kind AS view_kind, v.section, v.sources, detector = 'v2_collective' AS collective,
         CASE detector WHEN 'v3_target' THEN 4 WHEN 'v3_morphology' THEN 3 WHEN 'v2_exact' THEN 2 ELSE 1 END AS priority
  FROM mention_row m JOIN view v USING (tid, view_no))""",
])
#: What the reconciliation makes of the mentions, by template.
DERIVED_SQL = """prop AS (
  SELECT tid, target, status, phenotype, text AS evidence, min(ord) AS ord, max(priority) AS priority,
         list_transform(list_sort(list(DISTINCT {'p': -priority, 'd': detector})), lambda x: x.d) AS detectors,
         list_sort(list(DISTINCT view_kind)) AS view_kinds, list_sort(list(DISTINCT language)) AS languages, list_sort(list(DISTINCT section)) AS sections,
         list_sort(list_distinct(flatten(list(sources)))) AS source_indices, max(conf) AS confidence, bool_and(collective) AS collective, bool_or(s IS NOT NULL) AS has_span,
         coalesce(list_sort(list(DISTINCT rule) FILTER (rule IS NOT NULL)), []) AS rules
  FROM mention GROUP BY tid, target, status, phenotype, text),
won AS (
  SELECT tid, target, CASE WHEN bool_or(status = 'positive') THEN 'positive' WHEN bool_or(status = 'uncertain') THEN 'uncertain' ELSE 'negative' END AS final_status
  FROM prop GROUP BY tid, target),
side AS (
  SELECT p.*, w.final_status, p.status = w.final_status AS winning FROM prop p JOIN won w USING (tid, target)
  WHERE p.status = w.final_status OR NOT EXISTS (FROM prop q WHERE q.tid = p.tid AND q.target = p.target AND q.status = w.final_status AND q.evidence = p.evidence)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tid, target, winning ORDER BY priority DESC, confidence DESC, evidence, ord) AS r FROM side),
resolved AS (
  SELECT tid, target, any_value(final_status) AS status, max(confidence) FILTER (winning) AS top, bool_or(NOT winning) AS conflict, bool_and(collective) FILTER (winning) AS whole
  FROM ranked GROUP BY tid, target),
chosen AS (
  SELECT c.* EXCLUDE (ord), row_number() OVER (PARTITION BY tid, target ORDER BY winning DESC, r) - 1 AS place,
         CASE WHEN len(view_kinds) > 1 THEN 'strict_and_linked' WHEN view_kinds[1] = 'linked' THEN 'linked_only' ELSE 'strict_only' END AS view_support,
         array_to_string(detectors, '+') AS detector_combination
  FROM ranked c WHERE (winning AND r <= 2) OR (NOT winning AND r <= 1)),
inventory AS (SELECT d.study, d.language_group, c.* FROM chosen c JOIN docs_t d USING (tid)),
base_won AS (
  SELECT tid, target, CASE WHEN bool_or(status = 'positive') THEN 'positive' WHEN bool_or(status = 'uncertain') THEN 'uncertain' ELSE 'negative' END AS status
  FROM base GROUP BY tid, target),
base_resolved AS (
  SELECT w.tid, w.target, w.status, bool_and(b.collective) FILTER (b.status = w.status) AS whole,
         bool_or(b.status <> w.status AND NOT EXISTS (FROM base q WHERE q.tid = b.tid AND q.target = b.target AND q.status = w.status AND q.text = b.text)) AS conflict
  FROM base_won w JOIN base b USING (tid, target) GROUP BY w.tid, w.target, w.status)"""


def _gold(source: str) -> str:
    official = "CASE WHEN d.study % 20 = 0 THEN (d.study // 20 + t.ord) % 2 END AS official"
    return (
        f"{FACTS_SQL}, {DERIVED_SQL}, gold AS (SELECT d.study, d.tid, t.target, t.ord, coalesce(r.status, 'unknown') AS status, {official} "
        f"FROM docs_t d CROSS JOIN targets t LEFT JOIN {source} r ON r.tid = d.tid AND r.target = t.target)"
    )


#: (study, tid, target, ord, status, official) under the morphology and under the base policy.
GOLD_SQL = _gold("resolved")
BASE_SQL = _gold("base_resolved")
